"""Optimal length buckets with token-budget batches.

1. Documents are cut into sequences of at most ``max_tokens`` words (whole
   texts: a long document gives several sequences).
2. The global histogram of sequence lengths (in steps of ``pad_multiple``
   words, one by default) has at most ``max_tokens / pad_multiple`` rows and
   goes to the driver, where dynamic programming picks the ``n_buckets`` upper
   bounds that minimise the total padding.
3. Each sequence takes the smallest bucket that holds it; inside a bucket,
   in (length, id, part) order, every ``token_budget // bound`` sequences form
   a batch. Global positions come from per-partition counts, so a bucket that holds a
   third of all sequences is numbered by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm._base import run_window, sorted_runs, words_of


def sequences(docs: DataFrame, max_tokens: int, id_col: str = "doc_id", text_col: str = "text",
              n_tokens: Column | None = None) -> DataFrame:
    """id, part, start, n_tokens: the spans of at most ``max_tokens`` tokens
    that together cover each text; a text without tokens gives one empty span.

    ``n_tokens`` overrides the token count of a text (default: its words).
    """
    n = n_tokens if n_tokens is not None else F.size(words_of(F.col(text_col)))
    counted = docs.select(F.col(id_col).alias("id"), n.cast("long").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / max_tokens), F.lit(0))
    return (counted.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
            .select("id", "part", (F.col("part") * max_tokens).alias("start"),
                    F.least(F.col("n") - F.col("part") * max_tokens, F.lit(max_tokens)).alias("n_tokens")))


def step_length(n_tokens: Column, pad_multiple: int) -> Column:
    """Length rounded up to a multiple of ``pad_multiple`` (at least one)."""
    return (F.greatest(F.ceil(n_tokens / pad_multiple), F.lit(1)) * pad_multiple).cast("long")


def optimal_bounds(histogram: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Upper bounds of the buckets, ascending.

    ``histogram``: (padded length, sequences, tokens) by ascending length.
    best[k][j] is the least padding of the first j lengths in k buckets; the
    cost of lengths i..j-1 in one bucket is length[j-1] * sequences - tokens.
    Ties take the earliest cut.
    """
    lengths = np.array([h[0] for h in histogram], dtype=np.int64)
    count = np.cumsum([0, *(h[1] for h in histogram)], dtype=np.int64)
    total = np.cumsum([0, *(h[2] for h in histogram)], dtype=np.int64)
    n = len(lengths)
    infinite = np.iinfo(np.int64).max // 2
    best = np.full(n + 1, infinite)
    best[0] = 0
    cuts: list[np.ndarray] = []
    for _ in range(min(n_buckets, n)):
        nxt, cut = np.full(n + 1, infinite), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            padding = best[:j] + lengths[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            cut[j] = padding.argmin()  # the first of equal ones
            nxt[j] = min(padding[cut[j]], infinite)
        best = nxt
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096,
         pad_multiple: int = 1, n_buckets: int = 8, token_budget: int = 65536,
         n_tokens: Column | None = None) -> DataFrame:
    """``id_col``, part, start, n_tokens, bucket, bucket_tokens, batch, slot.

    One row per sequence, none dropped.  ``batch`` counts from 0 in each
    bucket and ``slot`` from 0 in each batch; a batch holds at most
    ``token_budget // bucket_tokens`` sequences (at least one).  Null texts
    count as empty; null ids come first; identical rows are numbered in any
    order.  An empty table gives an empty result.
    """
    seqs = (sequences(docs, max_tokens, id_col, text_col, n_tokens)
            .withColumn("step", step_length(F.col("n_tokens"), pad_multiple)))
    order = ["step", "id", "part", "start", "n_tokens"]
    # Sorted by length first, so each bucket is a run of neighbouring partitions.
    runs = sorted_runs(seqs, order, "lengths")
    # At most max_tokens / pad_multiple rows.
    histogram = sorted((r["step"], r["n"], r["tokens"]) for r in runs.groupBy("step").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect())
    bounds = optimal_bounds(histogram, n_buckets) or [pad_multiple]
    number, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for k in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("step") <= bounds[k], k).otherwise(number)
        bound = F.when(F.col("step") <= bounds[k], bounds[k]).otherwise(bound)
    tagged = runs.withColumn("bucket", number).withColumn("bucket_tokens", bound.cast("long"))
    # (partitions + buckets) rows: the offset of each partition in each bucket.
    before = Window.partitionBy("bucket").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid", "bucket").agg(F.count("*").alias("n"))
               .select("_pid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    per_batch = F.greatest(F.floor(F.lit(token_budget) / F.col("bucket_tokens")), F.lit(1))
    position = F.col("offset") + F.row_number().over(run_window(order, "bucket")) - 1
    return (tagged.join(F.broadcast(offsets), ["_pid", "bucket"])
            .withColumn("_at", position)
            .select(F.col("id").alias(id_col), "part", "start", "n_tokens", "bucket", "bucket_tokens",
                    F.floor(F.col("_at") / per_batch).alias("batch"), (F.col("_at") % per_batch).alias("slot")))
