"""Table schemas (P7), built from field lists so they cannot drift apart.

raw    : timestamp, 26 payload fields, 15 derived metric fields, model  (43)
rollup : timestamp, PASSKEY, sample_count, 38 numeric fields x 5 stats (193)
"""

from __future__ import annotations

from pyspark.sql import types as T

from stationlake.functions.units import FIELD_MAPS

TIMESTAMP_COL = "timestamp"
STATION_COL = "PASSKEY"
STATION_CODE = "station_code"

# --- Fixed values: must equal the station report format -------------------
# Payload fields in report order, less `dateutc` (which becomes `timestamp`).
PAYLOAD_FIELDS: list[str] = [
    "PASSKEY", "stationtype", "runtime", "heap", "tempinf", "humidityin",
    "baromrelin", "baromabsin", "tempf", "humidity", "winddir", "windspeedmph",
    "windgustmph", "solarradiation", "uv", "rainratein", "eventrainin",
    "dailyrainin", "weeklyrainin", "monthlyrainin", "yearlyrainin",
    "totalrainin", "vpd", "wh65batt", "freq", "interval",
]
# Payload fields kept as text; every other payload field is a double.
STRING_PAYLOAD_FIELDS: frozenset[str] = frozenset({"PASSKEY", "stationtype", "freq"})
# Metric fields added by the unit conversion, in schema order.
DERIVED_FIELDS: list[str] = [metric for fields in FIELD_MAPS for metric in fields.values()] + ["thi"]
# Extra text field sent by stations, declared by hand at the end.
EXTRA_STRING_FIELDS: list[str] = ["model"]
# Statistics per numeric field, in column order.
ROLLUP_STATS: tuple[str, ...] = ("avg", "min", "max", "std", "mode")
# Rollup granularities and their bucket widths.
INTERVALS: dict[str, str] = {"1m": "1 minute", "1h": "1 hour", "1d": "1 day"}
# Rollup states kept beside the tables, by granularity.
STATE_TABLES: dict[str, str] = {"states_1h": "1h", "states_1d": "1d"}
# Table names of the store.
TABLE_NAMES: tuple[str, ...] = ("raw", "1m", "1h", "1d")
# ---------------------------------------------------------------------------

NUMERIC_PAYLOAD_FIELDS: list[str] = [f for f in PAYLOAD_FIELDS if f not in STRING_PAYLOAD_FIELDS]
AGGREGATABLE_FIELDS: list[str] = NUMERIC_PAYLOAD_FIELDS + DERIVED_FIELDS


def raw_schema(timestamp_type: T.DataType | None = None) -> T.StructType:
    """Raw readings: 43 columns.  ``timestamp_type`` defaults to TIMESTAMP_NTZ
    holding the UTC wall clock (session-zone independent)."""
    ts_type = timestamp_type or T.TimestampNTZType()
    fields = [T.StructField(TIMESTAMP_COL, ts_type, True)]
    for name in PAYLOAD_FIELDS:
        dtype = T.StringType() if name in STRING_PAYLOAD_FIELDS else T.DoubleType()
        fields.append(T.StructField(name, dtype, True))
    fields += [T.StructField(name, T.DoubleType(), True) for name in DERIVED_FIELDS]
    fields += [T.StructField(name, T.StringType(), True) for name in EXTRA_STRING_FIELDS]
    schema = T.StructType(fields)
    assert len(schema) == 43, len(schema)
    return schema


def stat_column(field: str, stat: str) -> str:
    return f"{field}_{stat}"


def rollup_schema(timestamp_type: T.DataType | None = None,
                  fields: list[str] | None = None) -> T.StructType:
    """Rollup table: 193 columns for the full field list."""
    ts_type = timestamp_type or T.TimestampNTZType()
    out = [
        T.StructField(TIMESTAMP_COL, ts_type, True),
        T.StructField(STATION_COL, T.StringType(), True),
        T.StructField("sample_count", T.LongType(), False),
    ]
    for name in fields if fields is not None else AGGREGATABLE_FIELDS:
        out += [T.StructField(stat_column(name, s), T.DoubleType(), True) for s in ROLLUP_STATS]
    schema = T.StructType(out)
    if fields is None:
        assert len(schema) == 193, len(schema)
    return schema


def state_schema(timestamp_type: T.DataType | None = None) -> T.StructType:
    """Rollup state: one row per (station, bucket), a multiset per field."""
    value = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType())])
    return T.StructType([
        T.StructField(TIMESTAMP_COL, timestamp_type or T.TimestampNTZType()), T.StructField(STATION_COL, T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.ArrayType(value)))])


def codes_schema() -> T.StructType:
    """Station dictionary: one row per station."""
    return T.StructType([T.StructField(STATION_COL, T.StringType()), T.StructField(STATION_CODE, T.IntegerType())])


def schema_for(table: str, timestamp_type: T.DataType | None = None) -> T.StructType:
    """Schema of a store table by name (S6); unknown names are an error."""
    if table == "raw":
        return raw_schema(timestamp_type)
    if table in INTERVALS:
        return rollup_schema(timestamp_type)
    if table in STATE_TABLES:
        return state_schema(timestamp_type)
    raise ValueError(f"unknown table {table!r}; expected one of {list(TABLE_NAMES)}")
