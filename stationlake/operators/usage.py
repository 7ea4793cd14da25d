"""Storage use against warning / error thresholds.

`report_usage` measures rows: the bytes of stored reports per station and in
total.  `usage_status` is a helper for operators of a store: it lists file
sizes per table (a ``binaryFile`` scan of ``path`` and ``length`` only).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.session import hadoop_path

# --- Fixed values -------------------------------------------------------------
BYTES_PER_GB = 1024 ** 3          # GiB
DEFAULT_WARNING_GB = 5.0
DEFAULT_ERROR_GB = 8.0
# ------------------------------------------------------------------------------


def status_of(size_gb, warning_gb: float, error_gb: float):
    """``error`` at or above the error threshold, ``warning`` at or above the
    warning threshold, else ``ok``."""
    return (F.when(size_gb >= F.lit(error_gb), F.lit("error"))
            .when(size_gb >= F.lit(warning_gb), F.lit("warning"))
            .otherwise(F.lit("ok")))


def _checked_thresholds(warning_gb: float, error_gb: float) -> None:
    if error_gb <= warning_gb:
        raise ValueError(f"the error threshold, {error_gb} GiB, must lie above the warning threshold, {warning_gb} GiB")


def report_usage(reports: DataFrame, station: Column, body: Column, warning_gb: float = DEFAULT_WARNING_GB,
                 error_gb: float = DEFAULT_ERROR_GB) -> DataFrame:
    """(station, reports, size_bytes, status) per station and, as ``*``, in
    total.  Rows without a station count under ``''``.

    One pass: bytes are summed per station map-side, and the total is a
    rollup of those sums.
    """
    _checked_thresholds(warning_gb, error_gb)
    per_station = reports.groupBy(F.coalesce(station, F.lit("")).alias("station")).agg(
        F.count("*").alias("reports"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("size_bytes"))
    both = per_station.rollup("station").agg(F.sum("reports").alias("reports"), F.sum("size_bytes").alias("size_bytes"),
                                             F.grouping("station").alias("whole"))
    return both.select(F.when(F.col("whole") == 1, F.lit("*")).otherwise(F.col("station")).alias("station"),
                       F.coalesce("reports", F.lit(0)).alias("reports"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
                       status_of(F.coalesce("size_bytes", F.lit(0)) / F.lit(float(BYTES_PER_GB)), warning_gb, error_gb).alias("status"))


def usage_status(spark: SparkSession, base: str, warning_gb: float = DEFAULT_WARNING_GB,
                 error_gb: float = DEFAULT_ERROR_GB, glob: str | None = None) -> DataFrame:
    """(table, files, size_bytes, size_gb, status) per table and in total."""
    _checked_thresholds(warning_gb, error_gb)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(base).select("path", "length")
    fs, hpath = hadoop_path(spark, base)
    root = fs.makeQualified(hpath).toUri().getPath().rstrip("/") + "/"
    # Listed paths carry the scheme; the base is cut off at their start only.
    rel = F.regexp_replace(F.col("path"), "^[A-Za-z0-9+.-]+:(//[^/]*)?" + re.escape(root), "")
    table = F.regexp_replace(F.split(rel, "/").getItem(0), r"\.parquet$", "")
    per_table = files.groupBy(table.alias("table")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes"))
    total = per_table.agg(F.lit("*").alias("table"),
                          F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"),
                          F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("size_bytes"))
    both = per_table.select("table", F.col("files").cast("bigint"),
                            F.col("size_bytes").cast("bigint")).unionByName(total)
    gb = F.col("size_bytes") / F.lit(float(BYTES_PER_GB))
    return both.select("table", "files", "size_bytes",
                       F.round(gb, 4).alias("size_gb"), status_of(gb, warning_gb, error_gb).alias("status"))
