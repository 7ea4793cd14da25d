"""Report ingest: typing, validation, rejects, alignment.

A report is refused whole when it lacks a key or time, names an unknown
station, carries a value that is not a finite number, or has a field the
schema does not know; ``reject_reason`` names the first failed check, in
the order the service applies them.  Valid reports become rows of the raw
schema: ``dateutc`` -> ``timestamp``, ``PASSKEY`` := station id, metric
fields added.  Everything is one projection plus one join to the
allow-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions.text import apart, with_form
from stationlake.functions.times import parse_dateutc
from stationlake.operators.metric import to_metric
from stationlake.operators.stations import with_station
from stationlake.schema import (EXTRA_STRING_FIELDS, NUMERIC_PAYLOAD_FIELDS, PAYLOAD_FIELDS,
                                STRING_PAYLOAD_FIELDS, raw_schema)

# --- Fixed values -------------------------------------------------------------
# A number as a station prints it: optional sign, digits, optional fraction
# and exponent.  Non-finite words (nan, inf) and suffixes (1.5d) are refused.
NUMBER_SHAPE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Report keys the schema knows: payload fields, dateutc and extra text fields.
KNOWN_KEYS: list[str] = PAYLOAD_FIELDS + ["dateutc"] + EXTRA_STRING_FIELDS
# ------------------------------------------------------------------------------


def parse_number(c: Column) -> Column:
    """Text -> double; null for absent text or text that is not a number.

    Written as ``value * (1.0 if well-formed else null)`` - exact, since
    multiplying by 1.0 changes no double - rather than a CASE WHEN around
    the cast: with two dozen fields in one projection, the generated code
    of the CASE WHEN form ran about three times slower.
    """
    return c.try_cast("double") * F.when(c.rlike(NUMBER_SHAPE), F.lit(1.0))


def finite(c: Column) -> Column:
    """Null for an infinite value: digits that overflow, as 1e999."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def type_report(df: DataFrame, form_col: str = "form") -> DataFrame:
    """Typed columns from a decoded form map, plus ``invalid_fields``.

    A field is invalid when present but not castable.  ``dateutc`` becomes
    ``dateutc`` (UTC wall-clock NTZ, null when absent or malformed).  The
    checks are a second projection over the typed columns, so each value is
    parsed once.
    """
    form = F.col(form_col)
    # Each field is looked up once: `element_at`, unlike `getItem`, is not copied
    # into every use.  What a form lacks is null.
    texts = {n: F.element_at(form, n) for n in [*PAYLOAD_FIELDS, *EXTRA_STRING_FIELDS]}
    is_text = STRING_PAYLOAD_FIELDS.union(EXTRA_STRING_FIELDS)
    out = df.withColumns({n if n in is_text else f"_text_{n}": c for n, c in texts.items()} | {
        "dateutc_text": F.element_at(form, "dateutc"),
        "unknown_fields": F.array_sort(F.array_except(F.map_keys(form), F.array(*[F.lit(k) for k in KNOWN_KEYS]))),
    })
    out = out.withColumns({n: parse_number(F.col(f"_text_{n}")) for n in NUMERIC_PAYLOAD_FIELDS}
                          | {"dateutc": apart(parse_dateutc("dateutc_text"))})
    out = out.withColumns({n: finite(F.col(n)) for n in NUMERIC_PAYLOAD_FIELDS})
    # A branch-free count first; the list of names is only built for the
    # (rare) reports that have an invalid field.
    flags = [F.col(f"_text_{n}").isNotNull() & F.col(n).isNull() for n in NUMERIC_PAYLOAD_FIELDS]
    n_bad = sum((c.cast("int") for c in flags[1:]), flags[0].cast("int"))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(flags, NUMERIC_PAYLOAD_FIELDS)]))
    out = out.withColumn("invalid_fields", F.when(n_bad > 0, names).otherwise(F.array().cast("array<string>")))
    return out.select(*df.columns, *PAYLOAD_FIELDS, *EXTRA_STRING_FIELDS, "dateutc_text", "dateutc", "invalid_fields",
                      "unknown_fields")


def reject_reason(has_station: Column) -> Column:
    """P2 + K4: first failed check, or null for a valid report."""
    key = F.col("PASSKEY")
    return (
        F.when(key.isNull() | (key == ""), F.lit("missing PASSKEY"))
        .when(~has_station, F.lit("unknown station"))
        .when(F.col("dateutc_text").isNull(), F.lit("missing dateutc"))
        .when(F.col("dateutc").isNull(), F.lit("invalid dateutc"))
        .when(F.size("invalid_fields") > 0,
              F.concat(F.lit("invalid number: "), F.array_join("invalid_fields", ",")))
        .when(F.size("unknown_fields") > 0,
              F.concat(F.lit("unknown field: "), F.array_join("unknown_fields", ",")))
    )


def check_forms(forms: DataFrame, stations: DataFrame, pepper: str, form_col: str = "form") -> DataFrame:
    """Typed reports (from a decoded form map) with ``station_id`` and
    ``reject_reason``.

    The allow-list join is a left join on the key digest; the mapping has
    one row per key, so it never multiplies report rows.
    """
    typed = type_report(forms, form_col)
    joined = with_station(typed, stations, F.col("PASSKEY"), pepper)
    return joined.withColumn("reject_reason", reject_reason(F.col("station_id").isNotNull()))


def decode_and_check(reports: DataFrame, stations: DataFrame, pepper: str, body_col: str = "body") -> DataFrame:
    """``check_forms`` on urlencoded report bodies."""
    return check_forms(with_form(reports, body_col), stations, pepper)


def accepted_rows(checked: DataFrame, seq_col: str = "received") -> DataFrame:
    """P4 + P8 + P5: valid reports as raw-schema rows plus ``seq``."""
    ok = checked.filter(F.col("reject_reason").isNull())
    renamed = ok.withColumns({"timestamp": F.col("dateutc"), "PASSKEY": F.col("station_id")})
    # Working columns (form, checks, report ids) are not part of the table.
    own = ["timestamp", *PAYLOAD_FIELDS, *EXTRA_STRING_FIELDS, seq_col]
    return align(to_metric(renamed.select(*own)), raw_schema(), keep=[seq_col]).withColumnRenamed(seq_col, "seq")


def rejected(checked: DataFrame, id_cols: list[str]) -> DataFrame:
    """K4: refused reports and why; nothing of them is stored."""
    return checked.filter(F.col("reject_reason").isNotNull()).select(*id_cols, "reject_reason")


def ingest(reports: DataFrame, stations: DataFrame, pepper: str, body_col: str = "body",
           seq_col: str = "received") -> tuple[DataFrame, DataFrame]:
    """Full write path for a batch: (accepted raw rows, rejects)."""
    checked = decode_and_check(reports, stations, pepper, body_col)
    keep = [c for c in reports.columns if c != body_col]
    return accepted_rows(checked, seq_col), rejected(checked, keep)


def align(df: DataFrame, schema: T.StructType, on_unknown: str = "fail",
          keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Schema order, typed null for missing columns.

    Unknown columns fail (``on_unknown="fail"``) or are dropped ("drop");
    ``keep`` names extra columns carried at the end.  An uncastable value
    fails the job (ANSI cast); with ``strict=False`` it becomes null.
    """
    keep = keep or []
    names, have = set(schema.fieldNames()), {f.name: f.dataType for f in df.schema.fields}
    unknown = [c for c in have if c not in names and c not in keep]
    if unknown and on_unknown == "fail":
        raise ValueError(f"the table has no column for {', '.join(sorted(unknown))}")
    cols = []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif have[f.name] == f.dataType:
            cols.append(f"`{f.name}`")
        else:
            c = F.col(f.name)
            cols.append((c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols, *keep)

