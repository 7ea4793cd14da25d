"""Text helpers: urlencoded form decoding (S2), comma lists (F11), id test.

All are compositions of built-in array / string expressions (no UDF); the
per-row work is bounded by the number of form pairs in one report.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -------------------------------------------------------------
# A station id (salted hash) starts with this prefix; "*" is the wildcard.
STATION_ID_PREFIX = "pbkdf2_sha256$"
WILDCARD = "*"
# ------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apart(c: Column) -> Column:
    """The same value; its projection stays out of whole-stage code.

    There, a projection of dozens of texts is one method, too long for the JVM
    to compile; elsewhere it is cut into short ones.  A lambda keeps it out."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def _unquote_plus(c: Column) -> Column:
    """``+`` -> space, then every valid %XX; a malformed escape stays as text.

    A lone ``%`` is escaped itself before decoding, so the valid escapes
    around it are decoded; bytes that are no UTF-8 become U+FFFD."""
    decoded = F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    # Most fields are plain numbers: nothing to decode.
    return F.when(F.contains(c, F.lit("%")), decoded).when(
        F.contains(c, F.lit("+")), F.replace(c, F.lit("+"), F.lit(" "))).otherwise(c)


def form_pairs(body: Column | str) -> Column:
    """array<struct<k, v>> of the decoded pairs, in order; empty pairs
    skipped, a pair without '=' has a blank value."""
    parts = F.filter(F.split(_col(body), "&"), lambda p: p != F.lit(""))
    return F.transform(parts, lambda p: F.struct(
        _unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.instr(p, "=") > 0, _unquote_plus(F.substr(p, F.instr(p, "=") + 1)))
         .otherwise(F.lit("")).alias("v"),
    ))


KV_TYPE = "array<struct<k:string,v:string>>"


def _last_wins(kv: Column) -> Column:
    """Fold pairs (last occurrence first) into a list keeping the first
    pair per key."""
    return F.aggregate(
        kv, F.array().cast(KV_TYPE),
        lambda acc, x: F.when(F.array_contains(acc["k"], x["k"]), acc)
                        .otherwise(F.concat(acc, F.array(x))),
    )


def decode_form(body: Column | str) -> Column:
    """map<string,string>; a repeated key resolves to its LAST value.

    One pass: the decoded pairs (reversed, so the last occurrence comes
    first) are folded into a list that takes a pair only if its key is not
    in it yet.  The pair array occurs once in the expression, so the body is
    split and decoded once per report even when Catalyst copies the
    expression into a pushed-down filter.
    """
    return F.map_from_entries(_last_wins(F.reverse(form_pairs(body))))


# Escapes that keep a body from being decoded before it is cut: ``&``, ``=`` and all above ASCII.
CUTTING_ESCAPE = "%(26|3[Dd]|[89A-Fa-f])"


def _cut_pairs(body: Column) -> Column:
    """`form_pairs`, with a body decoded as one text where that is the same:
    no escape stands for a separator, none above ASCII (whose bytes are
    decoded together), and no pair is empty."""
    whole = ~(body.rlike(CUTTING_ESCAPE) | F.contains(body, F.lit("&&")) | body.startswith("&") | body.endswith("&")
              | (body == ""))
    cut = F.transform(F.split(_unquote_plus(body), "&"), lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("k"),
        F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit("")).alias("v")))
    return F.when(whole, cut).otherwise(form_pairs(body))


def with_form(df, body_col: str = "body", out_col: str = "form"):
    """S2 on a DataFrame: adds ``out_col`` = decoded map (last value wins).

    The decoded pairs are computed once into a column; a report whose keys
    are all distinct (the usual case) becomes a map directly, and only one
    with a repeated key pays for the fold.  Catalyst keeps the two
    projections apart: the pair column is referenced several times and is
    not cheap.
    """
    staged = df.withColumn("_kv", F.reverse(_cut_pairs(F.col(body_col))))
    kv = F.col("_kv")
    distinct = F.size(F.array_distinct(kv["k"])) == F.size(kv)
    form = F.when(distinct, F.map_from_entries(kv)).otherwise(F.map_from_entries(_last_wins(kv)))
    return staged.withColumn(out_col, form).drop("_kv")


def decode_form_multi(body: Column | str) -> Column:
    """S2, capture-log form: map<string, array<string>> keeping every value."""
    pairs = form_pairs(body)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    vals = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k),
                                                   lambda p: p["v"]))
    return F.map_from_arrays(keys, vals)


def split_csv(c: Column | str) -> Column:
    """comma list -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)),
                    lambda x: x != F.lit(""))


def is_station_id(c: Column | str) -> Column:
    """already a station id (or the wildcard), so no lookup needed."""
    x = _col(c)
    return (x == F.lit(WILDCARD)) | x.startswith(STATION_ID_PREFIX)
