"""Modes from bounded heavy-hitter summaries.

A summary follows the most frequent values of a field in a bucket with a bounded
number of counters, and merges with others (Spark's ``approx_top_k``
state, a frequent-items sketch).  It bounds every count: a value that it names
was seen ``estimate - slack`` to ``estimate`` times, any other at most twice
``slack`` times, as values with a lower bound below the slack are not named.
The slack is zero as long as no counter had to be given up.

The bounds settle the mode of a bucket where

- the slack is zero: all counts are exact, ties go to the smallest value, or
- the lower bound of the most frequent value is above the upper bounds of all
  others, named or not.

A summary that has just given up all its counters is taken for an empty one
when summaries merge, and its values are then missing from the total.  So each
total is held against a plain count; where they differ, nothing is settled, nor
where more values are followed than named.

Everything else is left open and counted exactly, those fields of those
buckets alone.  The rows of a hot bucket are summarised by each task, so a
summary per task and bucket is shuffled, not a row per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the sketch's published byte format the number of all values
#: begins at byte 17 and the slack at byte 25, little-endian longs; an empty
#: summary is shorter than that.
TOTAL, SLACK = 17, 25

#: Three quarters of a hash table of 512 places, which grows with the values that a
#: bucket has.  Three quarters of a power of two let a summary name all that it
#: follows; other sizes settle less, and the modes stay the same.
TRACKED = 384


def _bytes(at: int, name: str) -> str:
    return f"hex(substring(`_sum_{{f}}`.sketch, {at}, 8)) AS `{name}_{{f}}`"


def _number(hexed: str) -> str:
    """The little-endian long that ``hexed`` names: its bytes turned round."""
    return f"coalesce(cast(conv(regexp_replace(reverse({hexed}), '(.)(.)', '$2$1'), 16, 10) AS bigint), 0L)"


def summarised(rows: DataFrame, keys: list[str], fields: list[str], tracked: int = TRACKED) -> DataFrame:
    """``keys`` and per field ``_sum_<field>``, the summary of its values, and
    ``_n_<field>``, their number.  Negative zero counts as zero."""
    return rows.groupBy(*keys).agg(
        *[F.expr(f"approx_top_k_accumulate(`{f}` + 0.0D, {tracked}) FILTER (WHERE `{f}` IS NOT NULL) AS `_sum_{f}`")
          for f in fields],
        *[F.expr(f"count(`{f}`) AS `_n_{f}`") for f in fields])


def settled(rows: DataFrame, keys: list[str], fields: list[str], tracked: int = TRACKED) -> DataFrame:
    """``keys``, per field ``_mode_<field>`` where the bounds settle it (null
    for a field without values), and ``_open``, the places in ``fields`` of
    those that they do not settle."""
    def each(*made: str) -> list[Column]:
        return [F.expr(m.replace("{f}", f)) for m in made for f in fields]

    best = summarised(rows, keys, fields, tracked).select(
        *keys, *each(f"approx_top_k_estimate(`_sum_{{f}}`, {tracked}) AS `_seen_{{f}}`", "`_n_{f}`",
                     _bytes(TOTAL, "_total"), _bytes(SLACK, "_slack"))).select(
        "*", *each("array_max(transform(`_seen_{f}`, x -> struct(x.count AS n, -x.item AS v))) AS `_best_{f}`"))
    exact = "aggregate(`_seen_{f}`, 0L, (a, x) -> a + x.count) = `_n_{f}`"
    apart = (f"size(`_seen_{{f}}`) < {tracked} AND {_number('`_total_{f}`')} = `_n_{{f}}` AND "
             f"exists(array({_number('`_slack_{f}`')}), s -> `_best_{{f}}`.n > 3 * s AND "
             "size(filter(`_seen_{f}`, x -> x.count >= `_best_{f}`.n - s)) = 1)")
    judged = best.select(
        *keys, *each("-`_best_{f}`.v AS `_top_{f}`",
                     f"coalesce(if(`_slack_{{f}}` IN ('', '{'0' * 16}'), {exact}, {apart}), false) AS `_sure_{{f}}`"))
    left = ", ".join(f"if(`_sure_{f}`, NULL, {i}S)" for i, f in enumerate(fields))
    return judged.select(*keys, *each("if(`_sure_{f}`, `_top_{f}`, NULL) AS `_mode_{f}`"),
                         F.expr(f"array_compact(array({left})) AS _open"))


def open_values(rows: DataFrame, judged: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, fid, v): the values of the fields that `settled` left open."""
    left = judged.filter(F.size("_open") > 0).select(*keys, "_open")
    values = F.expr("array(" + ", ".join(f"`{f}`" for f in fields) + ")").alias("_values")
    pairs = F.expr("transform(_open, i -> struct(i AS fid, get(_values, i) AS v))")
    return (rows.select(*keys, values).join(left, keys).select(*keys, F.inline(pairs))
            .filter(F.col("v").isNotNull()))
