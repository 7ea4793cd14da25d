"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationlake.session import checkpoint_dir, drop_staging

#: White space as the contracts define it: the ASCII characters 0x20 and 0x09-0x0D.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda that names an outer expression computes it again for every
    element; bound as a lambda variable it is computed once per row.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words (runs without white space); empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def row_key(id_col: Column, text: Column) -> Column:
    """128-bit key of a row from its id and whole text; never null.  Rows
    that share it hold the same id and the same text."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(id_col, t).alias("a"), F.xxhash64(F.lit("row"), t, id_col).alias("b"))


_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Staged tables made inside are dropped at the end: write the result
    inside, since operators return frames that still read what they staged."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            unstage(spark, path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint folder and
    read it back: lineage ends there, and ids that depend on the physical
    partition are fixed.  Dropped by `staging`, or with the checkpoint folder."""
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like `stage`, with the folder, for callers that drop it themselves."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, path: str) -> None:
    drop_staging(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_runs(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` globally sorted by ``order`` and staged, with ``_pid`` (the
    range partition) and ``_pos`` (unique; breaks ties between equal rows).

    The tie-breaker is part of the range key, so rows that are equal in
    every sort column still spread over partitions.  ``df`` is staged first:
    a range partitioning reads its input twice, once to sample it.
    """
    rows, path = stage_at(df.withColumn("_pos", F.monotonically_increasing_id()), f"{name}-rows")
    n = shuffle_partitions(df.sparkSession)
    runs = stage(rows.repartitionByRange(n, *order, F.xxhash64("_pos"), "_pos")
                 .withColumn("_pid", F.spark_partition_id()), name)
    unstage(df.sparkSession, path)
    return runs


def run_window(order: list[str], *keys: str) -> Window:
    """Window over the rows of one run (a bounded range partition)."""
    return Window.partitionBy("_pid", *keys).orderBy(*order, F.xxhash64("_pos"), "_pos")
