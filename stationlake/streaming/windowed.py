"""

For feeds that send each reading once, the rollup is a windowed aggregation in
update mode: the state store keeps every open bucket, a micro-batch emits the
buckets it changed, and nothing is read again.  Corrections need
`streaming.ingest`, which can take a replaced reading out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions.times import known_interval
from stationlake.operators.rollup import present_fields, stat_exprs
from stationlake.operators.upsert import latest_wins
from stationlake.schema import INTERVALS, ROLLUP_STATS, STATION_COL, TIMESTAMP_COL, rollup_schema, stat_column
from stationlake.sources import store

BATCH = "batch"


def windowed_rollup(readings: DataFrame, interval: str, fields: list[str] | None = None,
                    watermark: str | None = None) -> DataFrame:
    """Rollup of a stream (or a batch) of readings by event-time window.

    The same columns as `rollup`.  Without a ``watermark`` no bucket is ever
    closed: a reading of any age counts, and the state grows with the buckets.
    With one, buckets older than it are dropped from the state, and later
    readings for them are ignored.
    """
    known_interval(interval)
    fields = present_fields(readings, fields)
    if watermark:
        readings = readings.withWatermark(TIMESTAMP_COL, watermark)
    out = readings.groupBy(F.window(TIMESTAMP_COL, INTERVALS[interval]), STATION_COL).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *stat_exprs(fields, with_mode=True))
    return out.select(F.col("window.start").alias(TIMESTAMP_COL), STATION_COL, "sample_count",
                      *[stat_column(f, s) for f in fields for s in ROLLUP_STATS])


def _path(base: str, interval: str) -> str:
    return f"{base.rstrip('/')}/windowed/{known_interval(interval)}"


def start_windowed_rollup(readings: DataFrame, base: str, interval: str, checkpoint: str,
                          fields: list[str] | None = None, watermark: str | None = None, available_now: bool = False):
    """Start the rollup of a stream of readings; returns the StreamingQuery.

    Each batch's changed buckets go to ``<base>/windowed/<interval>/batch=<id>``,
    which a replay of the batch overwrites with the same rows: state and
    progress are kept in ``checkpoint``, a shared, durable folder.
    """
    path = _path(base, interval)

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = (windowed_rollup(readings, interval, fields, watermark).writeStream.outputMode("update")
              .foreachBatch(write).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_windowed(spark: SparkSession, base: str, interval: str, fields: list[str] | None = None) -> DataFrame:
    """The buckets as last emitted, in the rollup schema (of ``fields``)."""
    schema = rollup_schema(fields=fields)
    path = _path(base, interval)
    if not store.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
    return latest_wins(rows, seq=BATCH).select(*schema.fieldNames())
