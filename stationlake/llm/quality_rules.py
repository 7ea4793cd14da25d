"""Quality rules: learned decision lists over text statistics.

`with_statistics` computes whole-text statistics in one projection.  `learn`
induces an ordered list of rules for low-quality documents by sequential
covering: a rule is grown on two thirds of the labelled rows by adding the
threshold condition with the highest information gain, pruned on the last
third by cutting trailing conditions, accepted if it is precise enough, and
the rows it covers leave the table before the next rule is grown.  All rows
with a label take part; each step is one aggregate that returns counts per
(feature, threshold), so the driver sees a bounded histogram and never a row.
`rule_column` turns the list into an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import WS_CHARS, let, row_key, stage_at, unstage, words_of

#: Words in a repeat window.
WINDOW = 5

#: Features of a rule, as expressions over the statistics.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "repeat_per_word": "n_repeat_words / greatest(n_words, 1)",
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a `WINDOW`-word window found twice or more.

    Windows are compared by their 64-bit hash within one text.  A text
    without a repeat costs one hash set; otherwise the (hash, position)
    pairs are sorted, equal neighbours give the repeated positions, and each
    covers the words up to the next one.
    """
    hashes = F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))))

    def positions(pairs: Column) -> Column:
        def same(at: Column, h: Column) -> Column:
            return F.coalesce(F.get(pairs, at)["h"] == h, F.lit(False))
        hit = F.filter(pairs, lambda e, k: same(k - 1, e["h"]) | same(k + 1, e["h"]))
        return F.sort_array(F.transform(hit, lambda e: e["p"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.get(at, k + 1) - p)),
                           F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(pairs, positions), covered))

    return let(hashes, count)


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` plus one struct column ``_stats`` (all longs).

    Words are runs without white space; lines are split at newlines.  Null
    text counts as empty: no words and one line.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_word = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(F.split(text, "\n"), lambda lines: F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        let(F.filter(lines, lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""),
            lambda full: (F.size(full) - F.size(F.array_distinct(full))).cast("long")).alias("n_dup_lines")))
    return (df.withColumn("_w", by_word).withColumn("_l", by_line)
            .withColumn("_stats", F.struct(
                "_w.n_words", "_w.word_chars", "_w.n_repeat_words", "_l.n_lines", "_l.n_dup_lines",
                _kept_chars(text, r"[^#*$%&|<>]+").alias("n_symbols"),
                _kept_chars(text, r"[^!?]+").alias("n_marks"),
                _kept_chars(text, r"[^\p{Lu}]+").alias("n_upper")))
            .drop("_w", "_l"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` (at_least) or ``feature < threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _thresholds(labelled: DataFrame, n_cuts: int) -> dict[str, list[float]]:
    """Candidate cuts per feature: quantiles of either class."""
    cuts = [(k + 1) / (n_cuts + 1) for k in range(n_cuts)]
    quantiles = [F.percentile_approx(F.when(F.col("bad") == b, F.col(f"x.{f}")), cuts, 10000).alias(f"{f}_{b}")
                 for f in FEATURES for b in (True, False)]
    row = labelled.agg(*quantiles).first()
    return {f: sorted({v for b in (True, False) for v in (row[f"{f}_{b}"] or [])}) for f in FEATURES}


def _coded(labelled: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Rows counted by their thresholds passed: one cell per distinct vector."""
    def code(f: str) -> Column:
        if not cuts[f]:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c <= F.col(f"x.{f}")))

    codes = [code(f).alias(f) for f in FEATURES]
    return (labelled.select("growing", "bad", *codes).groupBy("growing", *FEATURES)
            .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")))


def _on_codes(rule: list[tuple[str, bool, int]]) -> Column:
    """``code > k`` says that the value reaches the feature's k-th cut."""
    return _all([F.col(f) > k if up else F.col(f) <= k for f, up, k in rule])


def _grow(cells: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> list[tuple[str, bool, int]]:
    rule: list[tuple[str, bool, int]] = []
    while len(rule) < max_conditions:
        long = (cells.where(F.col("growing") & _on_codes(rule))
                .select("p", "n", F.explode(F.array(*[
                    F.struct(F.lit(f).alias("f"), F.col(f).alias("code")) for f in FEATURES])).alias("c"))
                .groupBy("c.f", "c.code").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in long.collect():  # at most features x cuts rows
            counts.setdefault(r["f"], {})[r["code"]] = (r["p"], r["n"])
        if not counts:
            break
        p_all, n_all = (sum(v[i] for v in next(iter(counts.values())).values()) for i in (0, 1))
        if not p_all or not n_all:
            break
        now, best = math.log2(p_all / (p_all + n_all)), (1e-9, None)
        for f in FEATURES:
            for k in range(len(cuts[f])):
                p_up = sum(p for code, (p, _) in counts[f].items() if code > k)
                n_up = sum(n for code, (_, n) in counts[f].items() if code > k)
                for up, p, n in ((True, p_up, n_up), (False, p_all - p_up, n_all - n_up)):
                    gain = p * (math.log2(p / (p + n)) - now) if p else 0.0
                    if gain > best[0]:
                        best = (gain, (f, up, k))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(cells: DataFrame, rule: list[tuple[str, bool, int]]) -> tuple[int, int, int]:
    """(conditions to keep, positives, negatives): the prefix of the rule with
    the best (p - n) / (p + n) on the pruning rows; counts over all rows."""
    sums = []
    for k in range(1, len(rule) + 1):
        for side, name in ((~F.col("growing"), "prune"), (F.lit(True), "all")):
            for c in "pn":
                sums.append(F.sum(F.when(side & _on_codes(rule[:k]), F.col(c)).otherwise(0)).alias(f"{name}_{c}_{k}"))
    r = cells.agg(*sums).first()
    worth = {k: (r[f"prune_p_{k}"] - r[f"prune_n_{k}"]) / max(1, r[f"prune_p_{k}"] + r[f"prune_n_{k}"])
             for k in range(1, len(rule) + 1)}
    keep = max(worth, key=lambda k: (worth[k], -k))
    return keep, r[f"all_p_{keep}"], r[f"all_n_{keep}"]


def learn(labelled: DataFrame, n_cuts: int = 31, max_rules: int = 8, max_conditions: int = 3,
          min_precision: float = 0.97, min_share: float = 0.005) -> list[Rule]:
    """Ordered rules for bad documents from (``bad`` boolean, ``x`` struct of
    `FEATURES`, ``growing`` boolean).

    Candidate cuts are drawn anew from the rows that no rule covers yet, so
    later rules see the remaining bad rows in finer steps.  Stops when a
    pruned rule is less precise than ``min_precision``, has too few rows to
    say so (nine in ten after Laplace's correction), covers less than
    ``min_share`` of the bad rows, or after ``max_rules``.  Without bad or
    without good rows there is no rule.
    """
    spark = labelled.sparkSession
    rows, rows_path = stage_at(labelled, "labelled")
    total = rows.where("bad").count()
    found: list[Rule] = []
    left = rows
    while total and len(found) < max_rules:
        cuts = _thresholds(left, n_cuts)
        cells, path = stage_at(_coded(left, cuts), "cells")
        codes = _grow(cells, cuts, max_conditions)
        keep, p, n = _prune(cells, codes) if codes else (0, 0, 0)
        unstage(spark, path)
        if p < max(1, min_share * total) or p < min_precision * (p + n) or (p + 1) < 0.9 * (p + n + 2):
            break
        rule = tuple(Condition(f, up, cuts[f][k]) for f, up, k in codes[:keep])
        found.append(rule)
        left = left.where(~_all([c.holds(F.col(f"x.{c.feature}")) for c in rule]))
    unstage(spark, rows_path)
    return found


def rule_column(rules: list[Rule]) -> Column:
    """The first matching rule's text (``base`` first), else null."""
    chain = F.when(base_failed(), F.lit("base"))
    for i, rule in enumerate(rules):
        chain = chain.when(_all([c.holds(F.expr(FEATURES[c.feature])) for c in rule]),
                           F.lit(f"{i + 1}: " + " and ".join(map(str, rule))))
    return chain.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", **learning) -> DataFrame:
    """id, key, the statistics, base_failed, rule, kept: one row per document.

    ``labels`` gives 0 (bad) or 1 per id; null labels and null ids are
    ignored, and an id labelled several times counts as its lowest label.
    Without usable labels only the base rule rejects.  ``key`` is the row key
    of (id, whole text), so a document is found again even if its id is null
    or repeated.  Texts are read once: the statistics are staged, and both the
    training rows and the verdicts come from that table.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stats, _ = stage_at(with_statistics(thin).select("id", row_key(F.col("id"), F.col("text")).alias("key"),
                                                     "_stats.*"), "statistics")
    by_id = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good"))
             .where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good")))
    labelled = (stats.join(by_id, "id")
                .where(~base_failed())  # the base rule comes first in the list
                .select((F.col("good") == 0).alias("bad"),
                        F.struct(*[F.expr(e).alias(f) for f, e in FEATURES.items()]).alias("x"),
                        (F.pmod(F.xxhash64(F.lit("grow"), "id"), F.lit(3)) < 2).alias("growing")))
    rules = learn(labelled, **learning)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", rule_column(rules))
    return judged.withColumn("kept", F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              **learning) -> DataFrame:
    """The documents (all their columns) that no rule rejects."""
    bad = judge(docs, labels, id_col, text_col, **learning).where("not kept").select("key").distinct()
    whole = docs.select(F.struct("*").alias("_row"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    return whole.join(bad, "key", "left_anti").select("_row.*")
