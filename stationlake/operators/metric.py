"""Metric conversion of a readings frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions import units


def to_metric(df: DataFrame, keep_original: bool = True) -> DataFrame:
    """Add the metric columns and ``thi`` in one projection.

    A source column absent from ``df`` adds nothing; a null source gives a
    null metric value.  ``thi`` is added when ``temp_c`` can be formed and
    ``humidity`` is present, and is null unless both are non-null.  With
    ``keep_original=False`` each converted source column is dropped.
    """
    cols = set(df.columns)
    added: dict = {}
    converted: list[str] = []
    for fields, convert in units.CONVERSIONS:
        for src, dst in fields.items():
            if src in cols:
                added[dst] = convert(F.col(src))
                converted.append(src)
    if "temp_c" in added and "humidity" in cols:
        added["thi"] = units.thi(added["temp_c"], F.col("humidity"), unit="degC")
    out = df.withColumns(added) if added else df
    if not keep_original and converted:
        out = out.drop(*converted)
    return out
