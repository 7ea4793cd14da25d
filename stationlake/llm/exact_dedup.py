"""Exact dedup by a tree-merge of sorted digest runs.

Every partition of the input is a run: its texts, normalised, become
(SHA-256, byte length, second hash) keys, sorted and combined to the
smallest identifier and the number of rows.  Runs are then merged in
binomial rounds: in each round the runs whose numbers agree above the low
``fan_in_bits`` bits exchange their entries by key and a multiway sorted
merge keeps the smallest identifier, so after ceil(log(runs)) rounds one
logical run is left.  A key has at most one entry per run, hence a text that
makes up a third of the corpus never puts more than ``2**fan_in_bits``
entries of it into one merge.

An identifier is only kept for rows that agree in all three parts of the
key: the digest is verified at every level by the length and by an
independent hash of the whole text.

On the way back each run asks the merged run once per text, and rows meet
the answers of their own run: no join key holds more than one run's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import WS, stage

KEY = ["digest", "n_bytes", "witness"]


def normalised(text: Column) -> Column:
    """Every white-space run as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (run, digest, n_bytes, witness, row): one row per document.

    ``row`` orders documents: non-null ids first, then the id, then a unique
    position, so repeated rows are told apart.
    """
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return stage(norm.select(
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.lit("witness"), "norm").alias("witness"),
        F.struct(F.col("id").isNull().alias("no_id"), F.col("id"),
                 F.monotonically_increasing_id().alias("pos")).alias("row"),
    ), "digests")


def merge_round(runs: DataFrame, bits: int) -> DataFrame:
    """Merge groups of ``2**bits`` runs.

    ``min`` over a struct has no fixed-width buffer, so Spark plans it as
    sort-based aggregation: entries are sorted by key within their run,
    exchanged by (merged run, key), merged in order and reduced while
    streaming, with spilling sorts and a buffer of one row.
    """
    return (runs.groupBy(F.shiftright("run", bits).alias("run"), *KEY)
            .agg(F.min("keep").alias("keep"), F.sum("n").alias("n")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in_bits: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays.  Null texts
    are empty texts; a null id loses against any other id; among rows equal in
    id and text exactly one (the first in input order) is kept.  An empty
    table gives an empty result.
    """
    rows = digest_runs(docs, id_col, text_col)
    entries = rows.groupBy("run", *KEY).agg(F.min("row").alias("keep"), F.count("*").alias("n"))
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    merged, left = entries, n_runs
    while True:
        merged, left = merge_round(merged, fan_in_bits), -(-left // (1 << fan_in_bits))
        if left <= 1:
            break
    answers = (entries.select("run", *KEY)
               .join(merged.select(*KEY, "keep", F.col("n").alias("group_size")), KEY))
    out = rows.join(answers, ["run", *KEY])
    return out.select(
        F.col("row.id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row.pos") == F.col("keep.pos")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
