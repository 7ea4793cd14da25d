"""Contiguous, byte-balanced shards from global prefix sums.

Documents are sorted by id into range partitions; per-partition totals (one
row per partition) give every partition its starting offset, and a running
sum inside the partition gives every document the bytes before it.  Cutting
that global prefix sum at equal targets yields shards that are contiguous in
id order and differ by less than one document in bytes.  Only (id, size,
checksum) rows move: texts stay where they are until they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm._base import run_window, sorted_runs, stage_at, unstage

#: Bytes counted for a document besides its text (a length prefix).
OVERHEAD = 8


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, shard, slot: one row per input row.

    Size is the UTF-8 length plus `OVERHEAD` (null text: none).  Shard s takes
    the documents whose middle byte lies in the s-th of ``n_shards`` equal
    parts of all bytes; slot counts from 0 in id order.  Null ids come first;
    equal ids are ordered by checksum and size, identical rows arbitrarily.
    With fewer documents than shards some shards are empty, and an empty table
    gives an empty result.
    """
    return _placed(docs, F.col(id_col), F.col(text_col), n_shards).withColumnRenamed("id", id_col)


def _placed(docs: DataFrame, id_: Column, text: Column, n_shards: int, *others: str) -> DataFrame:
    """id, size, text_crc32, shard, slot and ``others``, one row per row."""
    text = F.coalesce(text, F.lit(""))
    thin = docs.select(id_.alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *others)
    order = ["id", "text_crc32", "size"]
    runs = sorted_runs(thin, order, "sizes")
    # One row per range partition: a single small window orders them.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (runs.groupBy("_pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
              .select("_pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                      F.sum("bytes").over(everything).alias("all_bytes")))
    w = run_window(order)
    placed = (runs.join(F.broadcast(totals), "_pid")  # as many rows as range partitions
              .withColumn("first", F.col("bytes_before") + F.sum("size").over(
                  w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("rank", F.col("rows_before") + F.row_number().over(w) - 1)
              .withColumn("shard", F.expr(f"cast((2 * first + size) * {n_shards} div (2 * all_bytes) as int)")))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))
    return (placed.join(F.broadcast(starts), "shard")  # n_shards rows at most
            .select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"), *others))


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents, all their columns, below ``path/_shard=<n>``.

    The input is copied once under row numbers, so every row goes to its own
    shard, also among rows of one id, size and checksum.  Each shard is written
    by several tasks of bounded size, ids ascending within a file.
    """
    if "_shard" in docs.columns:
        raise ValueError("the column _shard names the folders")
    rows, copy = stage_at(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), "shard-rows")
    row = F.col("row")
    shards = _placed(rows, row[id_col], row[text_col], n_shards, "_row").select("_row", F.col("shard").alias("_shard"))
    (rows.join(shards, "_row").hint("rebalance", "_shard").sortWithinPartitions("_shard", row[id_col])
     .select(*[row[c].alias(c) for c in docs.columns], "_shard")
     .write.partitionBy("_shard").parquet(path))
    unstage(docs.sparkSession, copy)
