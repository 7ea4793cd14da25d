"""Mixing sources to target weights by capped water-filling.

1. Every source gets a share of the budget in proportion to its weight; a
   source whose share is above ``max_epochs`` times its size is clamped there
   and the excess is dealt to the others by weight, round by round, until no
   source is above its cap.  A round is one aggregate of the source table.
2. A source's target is so many epochs of it.  Every document is taken for
   the whole epochs.  For the fraction, the documents stand in a seeded order
   and are taken from its start until the words of the target are reached; the
   document at the cut gives its first words only, so a source misses its
   target by less than a word whatever its sizes.
3. The words before a document in that order come from sorted runs: totals per
   (run, source) give each run its offset, so a source that holds a third of
   all rows is laid out by many tasks.  Only (source, id, size) rows move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm._base import run_window, sorted_runs, stage, words_of

_SOURCE = ["no_source", "source"]


def _sized(docs: DataFrame, id_: Column, text: Column, source: Column, seed: int, *others: Column) -> DataFrame:
    """Thin rows: id, source (null: last), size in words, place in the seeded order."""
    source = source.cast("string")
    return docs.select(
        id_.alias("id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string"))).alias("place"), *others)


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which ``least(cap, level * weight)`` sums to ``budget``.

    Each round clamps the sources that the last level puts above their cap
    and deals what they leave to the others; clamped sources never come back,
    since the level only rises.  Infinite if the caps hold less than the
    budget: every source is clamped then.
    """
    level, clamped = None, 0
    while True:
        above = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        caps, weights, n = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count(F.when(above, 1))).first()
        if level is not None and n == clamped:
            return level
        level, clamped = (budget - caps) / weights if weights else float("inf"), n


def _targets(thin: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """no_source, source, source_size, target: one row per source."""
    totals = thin.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    runs = sorted_runs(totals, _SOURCE, "mix-sources")
    # One row per range partition.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (runs.groupBy("_pid").agg(F.count("*").alias("n"))
               .select("_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    rank = F.col("offset") + F.row_number().over(run_window(_SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = stage(runs.join(offsets, "_pid").select(
        *_SOURCE, "source_size", weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap")),
        "mix-weights")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, share * words)
    return sources.select(*_SOURCE, "source_size",
                          F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _planned(thin: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """The rows of ``thin`` with source_size, target, whole (repetitions) and extra (words)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    thin = stage(thin, "mix-sizes")
    targets = _targets(thin, weights, share, max_epochs)
    order = [*_SOURCE, "place", "id", "size"]
    runs = sorted_runs(thin, order, "mix-order")
    # At most one row per run and per source: where in its source a run begins.
    before = Window.partitionBy(*_SOURCE).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (runs.groupBy("_pid", *_SOURCE).agg(F.sum("size").alias("words"))
             .select("_pid", *_SOURCE, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
             .join(targets, _SOURCE))
    inside = run_window(order, *_SOURCE).rowsBetween(Window.unboundedPreceding, 0)
    return (runs.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
            .join(parts, ["_pid", *_SOURCE])
            .withColumn("_first", F.col("offset") + F.col("_inside"))
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("long"))
            .withColumn("_cut", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)))
            .withColumn("extra", F.greatest(F.least(F.col("_cut") - F.col("_first"), F.col("size")),
                                            F.lit(0)).cast("long")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
             seed: int = 11) -> DataFrame:
    """``id_col``, source, size, source_size, target, whole, extra, taken: one
    row per input row.

    Size counts words (runs without ASCII white space; null text: none).
    Sources in code point order, the null source last, weigh ``weights`` in
    turn.  They share ``share`` times all words; none gets more than
    ``max_epochs`` times its own size.  ``taken`` = whole * size + extra words.

    A source without words has the target 0.  Null ids are placed like any
    other id; rows of one id stand together in the order, by size; which of
    two equal rows is cut is arbitrary, so equal input gives equal rows.  An
    empty table gives an empty result.
    """
    thin = _sized(docs, F.col(id_col), F.col(text_col), F.col(source_col), seed)
    plan = _planned(thin, weights, share, max_epochs)
    return plan.select(F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("source")).alias("source"), "size",
                       "source_size", "target", "whole", "extra",
                       (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
            seed: int = 11) -> DataFrame:
    """row (struct of all columns), repetition, text: the mix itself.

    Whole repetitions carry the whole text, counted from 0; the cut document's
    last one is its first ``extra`` words joined by single spaces.  Texts
    without words are in every whole repetition of their source.  The input is
    copied once, so that each of several equal rows meets its own plan.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), "mix-rows")
    row = F.col("row")
    thin = _sized(rows, row[id_col], row[text_col], row[source_col], seed, "_row")
    plan = _planned(thin, weights, share, max_epochs).select("_row", "size", "whole", "extra")
    last = F.col("whole") - F.when(F.col("extra") > 0, 0).otherwise(1)
    whole = (F.col("repetition") < F.col("whole")) | (F.col("extra") == F.col("size"))
    return (rows.join(plan, "_row").filter(last >= 0)
            .select("row", "whole", "extra", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("repetition"))
            .select("row", "repetition", F.when(whole, row[text_col]).otherwise(
                F.array_join(F.slice(words_of(row[text_col]), F.lit(1), F.col("extra").cast("int")), " ")).alias("text")))
