"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Each one runs a library operator over the whole driver tables (through the
fixtures in ``sources/fixtures.py``) and names its output columns exactly as
the matching SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions import units
from stationlake.functions.text import split_csv, with_form
from stationlake.functions.times import bucket, parse_dateutc, parse_iso
from stationlake.operators import ingest, stations
from stationlake.operators.rollup import rollup
from stationlake.operators.rollup_state import combine, rollup_of, state_of
from stationlake.operators.upsert import last_row, latest_wins, union_evolved
from stationlake.schema import (AGGREGATABLE_FIELDS, INTERVALS, NUMERIC_PAYLOAD_FIELDS, ROLLUP_STATS, STATION_COL,
                                TIMESTAMP_COL, raw_schema, stat_column)
from stationlake.session import checkpoint_dir
from stationlake.sinks import tables
from stationlake.sources import fixtures
from stationlake.sources.reports import read_reports, read_scopes, read_stations, with_log_columns
from stationlake.sources.store import range_of, read_all, resolve
from stationlake.streaming import ingest as stream
from stationlake.streaming.log import read_view

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# --- Fixed values: query parameters ------------------------------------------
SCAN_STATION = "st_7"
RANGE_START = "2024-01-10T07:00:00+07:00"      # 2024-01-10 00:00:00 UTC
RANGE_END = "2024-01-12T12:00:00Z"
ROLLUP_RANGE_START = "2024-01-10T00:30:00Z"    # not on a bucket edge
ROLLUP_RANGE_END = "2024-01-12 12:15:00"       # naive = UTC
EVOLVED_FROM = "2024-01-15 00:00:00"           # rows before lack `thi`
NEW_STATION_ORDINAL_BASE = 1_000_000_000_000
USAGE_WARNING_GB = 0.00001                     # per station: a fixture station sends some 10 KB
USAGE_ERROR_GB = 0.00003
CORRECTED = 10                                 # readings that come again with tempf + 1, by seq modulo 50
CORRECTED_SEQ = 1_000_000_000_000
# ------------------------------------------------------------------------------

READING_COLUMNS = [
    "timestamp", "PASSKEY", "seq", "stationtype", "baromrelin", "tempf", "humidity", "winddir",
    "windspeedmph", "rainratein", "vpd", "temp_c", "baromrel_hpa", "windspeed_ms", "rainrate_mm",
    "vpd_kpa", "thi",
]


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def round_stats(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round mean and std columns (summation order differs between engines)."""
    return df.withColumns({
        c: F.round(F.col(c), digits) for c in df.columns if c.endswith(("_avg", "_std"))
    })


def corrections(readings: DataFrame) -> DataFrame:
    """The readings that come again later, with another temperature."""
    return readings.filter(F.col("seq") % 50 == CORRECTED).withColumns(
        {"seq": F.col("seq") + CORRECTED_SEQ, "tempf": F.col("tempf") + 1.0})


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.readings(spark, sf_dir).select(*READING_COLUMNS)


# --- A1-A10: rollups -----------------------------------------------------------

def _rollup_query(interval: str) -> QueryFn:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_stats(rollup(fixtures.readings(spark, sf_dir), interval))
    q.__name__ = f"rollup_{interval}"
    return q


for _interval in ("1m", "1h", "1d"):
    register(f"rollup_{_interval}")(_rollup_query(_interval))


@register("rollup_wide")
def rollup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: all 38 fields x 5 stats (193 columns) over the aligned raw table."""
    aligned = ingest.align(fixtures.wide_readings(spark, sf_dir).drop("seq"), raw_schema())
    return round_stats(rollup(aligned, "1d", fields=AGGREGATABLE_FIELDS, mode_strategy="gathered"))


@register("rollup_coded")
def rollup_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide day rollups over station numbers, with the numbers.

    The dictionary is written for the early readings' stations and extended by
    the others'; the rollups go by the numbers and get their ids back."""
    aligned = ingest.align(fixtures.wide_readings(spark, sf_dir).drop("seq"), raw_schema())
    base = _folder(spark, "codes")
    tables.extend_codes(spark, base, aligned.filter(F.col(TIMESTAMP_COL) < F.lit(EVOLVED_FROM).cast("timestamp_ntz")))
    codes = tables.extend_codes(spark, base, aligned)
    rolled = rollup(aligned, "1d", fields=AGGREGATABLE_FIELDS, codes=codes, mode_strategy="gathered")
    return round_stats(rolled).join(codes, STATION_COL)


@register("rollup_bounded")
def rollup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide day rollups with modes from bounded summaries; only what
    their bounds leave open is counted value by value."""
    aligned = ingest.align(fixtures.wide_readings(spark, sf_dir).drop("seq"), raw_schema())
    return round_stats(rollup(aligned, "1d", fields=AGGREGATABLE_FIELDS, mode_strategy="bounded"))


@register("rollup_merged")
def rollup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, A9: day rollups after corrections, by merging states.

    Minute states of the readings add up to day states.  Some readings then
    come again with another value; the minutes they touch are taken out of the
    days as they were and put in as they are now."""
    readings = fixtures.readings(spark, sf_dir)
    fields = [f for f in AGGREGATABLE_FIELDS if f in readings.columns]
    again = corrections(readings)
    minute = bucket(TIMESTAMP_COL, "1m")
    touched = again.select(STATION_COL, minute.alias("_minute")).distinct()
    before = readings.withColumn("_minute", minute).join(touched, [STATION_COL, "_minute"], "left_semi").drop("_minute")
    after = latest_wins(before.unionByName(again))
    days = combine(state_of(readings, "1m", fields), "1d").withColumn("sign", F.lit(1))
    moves = state_of(after, "1m", fields).withColumn("sign", F.lit(1)).unionByName(
        state_of(before, "1m", fields).withColumn("sign", F.lit(-1)))
    moves = moves.withColumn(TIMESTAMP_COL, bucket(TIMESTAMP_COL, "1d"))
    return round_stats(rollup_of(combine(days.unionByName(moves), sign="sign"), fields))


# --- S2, P1, P3, F9, K4: the report path ---------------------------------------

@register("form_decode")
def form_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = with_form(fixtures.reports(spark, sf_dir))
    f = F.col("form")
    return rep.select(
        "event_id",
        f["PASSKEY"].alias("PASSKEY"), f["stationtype"].alias("stationtype"),
        f["dateutc"].alias("dateutc"), f["tempf"].alias("tempf"), f["humidity"].alias("humidity"),
        f["model"].alias("model"), f["freq"].alias("freq"), f["uv"].alias("uv"),
        F.size(F.map_keys(f)).cast("bigint").alias("n_keys"),
    )


@register("typed_reports")
def typed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = with_form(fixtures.reports(spark, sf_dir))
    t = ingest.type_report(rep)
    return t.select(
        "event_id", "PASSKEY", "stationtype", "dateutc", *NUMERIC_PAYLOAD_FIELDS, "freq", "model",
        F.array_join("invalid_fields", ",").alias("invalid_fields"),
    )


@register("parse_times")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fixtures.load(spark, sf_dir, "events")
    ts = F.col("ts")
    shifted = ts + F.expr("INTERVAL 7 HOURS")
    return ev.select(
        "event_id",
        parse_dateutc(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("dateutc_std"),
        parse_dateutc(F.date_format(ts, "yyyy-M-d H:m:s")).alias("dateutc_unpadded"),
        parse_dateutc(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).alias("dateutc_t"),
        parse_dateutc(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" 25:00:00"))).alias("dateutc_bad"),
        parse_iso(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("iso_z"),
        parse_iso(F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))).alias("iso_offset"),
        parse_iso(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("iso_naive"),
        parse_iso(F.date_format(ts, "yyyy-MM-dd")).alias("iso_date"),
        parse_iso(F.date_format(ts, "yyyy")).alias("iso_bad"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.decode_and_check(fixtures.reports(spark, sf_dir), fixtures.stations(spark, sf_dir), fixtures.PEPPER)


@register("ingest_accepted")
def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 43 columns that ingest stores, latest arrival per key."""
    return latest_wins(ingest.accepted_rows(_checked(spark, sf_dir)))


@register("rejected_reports")
def rejected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected(_checked(spark, sf_dir), ["event_id"])


# --- P5, P8, F1-F7, U1 ---------------------------------------------------------

@register("to_metric")
def to_metric_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 14 conversions and the index, over all 23 numeric fields."""
    return fixtures.wide_readings(spark, sf_dir)


@register("unit_functions")
def unit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.readings(spark, sf_dir)
    return r.select(
        "seq",
        units.mph_to_kmh("windspeedmph").alias("windspeed_kmh"),
        units.mph_to_ms("windspeedmph").alias("windspeed_ms"),
        units.inhg_to_hpa("baromrelin").alias("barom_hpa"),
        units.inhg_to_kpa("baromrelin").alias("barom_kpa"),
        units.inches_to_mm("rainratein").alias("rain_mm"),
        units.fahrenheit_to_celsius("tempf").alias("temp_c"),
    )


@register("thi")
def thi_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.readings(spark, sf_dir)
    rh = F.when(F.col("stationtype") != "error", F.col("humidity"))
    return r.select(
        "seq", "temp_c", rh.alias("humidity"),
        units.thi("temp_c", rh).alias("thi"),
        units.thi("tempf", rh, unit="degF").alias("thi_from_f"),
        units.thi(F.col("temp_c") + F.lit(273.15), rh, unit="K").alias("thi_from_k"),
    )


@register("align_schema")
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.align(_readings(spark, sf_dir).drop("seq"), raw_schema())


@register("union_evolved")
def union_evolved_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).select(STATION_COL, TIMESTAMP_COL, "seq", "tempf", "humidity", "thi")
    cut = F.lit(EVOLVED_FROM).cast("timestamp_ntz")
    old = (r.filter(F.col(TIMESTAMP_COL) < cut).drop("thi")
           .withColumn("humidity", F.col("humidity").cast("int")))
    new = r.filter(F.col(TIMESTAMP_COL) >= cut)
    return union_evolved(old, new).select(STATION_COL, TIMESTAMP_COL, "seq", "tempf", "humidity", "thi")


@register("union_supertypes")
def union_supertypes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 across kinds: number and text, date and time, and nested records
    whose fields differ."""
    r = fixtures.readings(spark, sf_dir)
    cut = F.lit(EVOLVED_FROM).cast("timestamp_ntz")
    at = F.col(TIMESTAMP_COL)
    old = r.filter(at < cut).select(
        "seq", F.col("seq").cast("int").alias("code"), F.to_date(at).alias("day"),
        F.struct(F.col("humidity").cast("int").alias("humidity")).alias("air"),
        F.array(F.col("humidity").cast("smallint"), F.lit(None)).alias("levels"))
    new = r.filter(at >= cut).select(
        "seq", F.concat(F.lit("n"), F.col("seq").cast("string")).alias("code"), at.alias("day"),
        F.struct("humidity", "stationtype").alias("air"), F.array("humidity").alias("levels"))
    both = union_evolved(old, new)
    return both.select("seq", "code", "day", "air.humidity", "air.stationtype", F.col("levels")[0].alias("level"),
                       F.size("levels").cast("bigint").alias("n_levels"))


@register("strict_cast")
def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of texts aligned to the typed schema; a text that is none
    of its type would fail the job."""
    r = _readings(spark, sf_dir).drop("seq")
    return ingest.align(r.select(*[F.col(c).cast("string").alias(c) for c in r.columns]), raw_schema())


# --- S3-S6, K1, W1, O1, O2, K5 --------------------------------------------------

@register("scan_station")
def scan_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    r = r.unionByName(corrections(r)).filter(F.col(STATION_COL) == SCAN_STATION)
    aligned = ingest.align(r, raw_schema(), keep=["seq"])
    return resolve(aligned, "raw")


@register("latest_reading")
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_row(_readings(spark, sf_dir))


@register("range_scan")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_of("raw", _readings(spark, sf_dir), RANGE_START, RANGE_END).orderBy(TIMESTAMP_COL)


@register("range_scan_1h")
def range_scan_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_stats(range_of("1h", fixtures.readings(spark, sf_dir), ROLLUP_RANGE_START, ROLLUP_RANGE_END))


@register("upsert_latest_wins")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = fixtures.daily_readings(spark, sf_dir).select(*READING_COLUMNS)
    return latest_wins(daily, [STATION_COL, TIMESTAMP_COL], seq="seq")


def feed_of(df: DataFrame, fields: list[str]) -> DataFrame:
    """K5: each station's newest reading and its last bucket of every
    granularity, as full rows.

    The last minute and hour lie inside the last day, so the newest time per
    station is found once, one semi-join narrows the readings to the last
    days, and each row is dealt to the channels whose last bucket holds it: one
    aggregate makes all channels.  A group is one station's day at most, so
    its mode is counted in the same aggregate.
    """
    newest = df.groupBy(F.col(STATION_COL).alias("_station")).agg(F.max(TIMESTAMP_COL).alias("_last"))
    last_day = df.join(newest, (F.col(STATION_COL) == F.col("_station"))
                       & (bucket(TIMESTAMP_COL, "1d") == bucket("_last", "1d")))
    channels = F.array(
        F.when(F.col(TIMESTAMP_COL) == F.col("_last"), F.struct(F.lit("raw").alias("data_type"), F.col("_last").alias("at"))),
        *[F.when(bucket(TIMESTAMP_COL, i) == bucket("_last", i), F.struct(F.lit(i).alias("data_type"), bucket("_last", i).alias("at")))
          for i in INTERVALS])
    dealt = last_day.select(STATION_COL, "seq", F.explode(F.array_compact(channels)).alias("c"), *fields)
    raw = F.first("c.data_type") == "raw"

    def stat(name: str, f: str) -> Column:
        c = F.col(f)
        if name == "avg":  # a raw message carries the reading itself
            return F.when(raw, F.max_by(c, "seq")).otherwise(F.avg(c))
        made = {"min": F.min, "max": F.max, "std": F.stddev_samp, "mode": lambda x: F.mode(x, deterministic=True)}[name](c)
        return F.when(~raw, made)

    return (dealt.groupBy(STATION_COL, "c").agg(
        F.when(~raw, F.count("*")).alias("sample_count"),
        *[stat(name, f).alias(stat_column(f, name)) for f in fields for name in ROLLUP_STATS])
        .select("c.data_type", STATION_COL, F.col("c.at").alias(TIMESTAMP_COL), "sample_count",
                *[stat_column(f, name) for f in fields for name in ROLLUP_STATS]))


@register("feed_latest_bucket")
def feed_latest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [f for f in AGGREGATABLE_FIELDS if f in READING_COLUMNS]
    return round_stats(feed_of(fixtures.readings(spark, sf_dir), fields))


# --- J1-J8, F11, F12 ----------------------------------------------------------

def _decoded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = with_form(fixtures.reports(spark, sf_dir))
    return rep.select("event_id", F.col("form")["PASSKEY"].alias("PASSKEY"))


@register("station_resolve")
def station_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.resolve_stations(_decoded_keys(spark, sf_dir),
                                     fixtures.stations(spark, sf_dir), fixtures.PEPPER).select("event_id", "station_id")


@register("station_unknown")
def station_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.unknown_stations(_decoded_keys(spark, sf_dir),
                                     fixtures.stations(spark, sf_dir), fixtures.PEPPER).select("event_id", "PASSKEY")


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.migrate_scopes(fixtures.scopes(spark, sf_dir), fixtures.stations(spark, sf_dir), fixtures.PEPPER)


@register("scope_migrate")
def scope_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _migrated(spark, sf_dir).select(
        "ordinal", "title",
        F.array_join("weatherstations", ",").alias("weatherstations"),
        F.array_join("unresolved", ",").alias("unresolved"),
        F.size("unresolved").cast("bigint").alias("n_unresolved"),
    )


@register("scope_migrate_strict")
def scope_migrate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 on the records that a first look finds resolvable."""
    fine = _migrated(spark, sf_dir).filter(F.size("unresolved") == 0).select("ordinal")
    strict = stations.resolve_scopes_strict(fixtures.scopes(spark, sf_dir).join(fine, "ordinal", "left_semi"),
                                            fixtures.stations(spark, sf_dir), fixtures.PEPPER)
    return strict.select("ordinal", "title", F.array_join("weatherstations", ",").alias("weatherstations"))


def _accepted_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = ingest.ingest(fixtures.reports(spark, sf_dir), fixtures.stations(spark, sf_dir), fixtures.PEPPER)
    return accepted.select(STATION_COL, "seq")


@register("scope_stations")
def scope_stations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted readings that each access record sees.  The records
    with the wildcard share their rows (see `scope_rows`)."""
    migrated = _migrated(spark, sf_dir).filter(F.col("ordinal").isNotNull())
    return stations.scope_rows(_accepted_stations(spark, sf_dir), migrated).select("ordinal", "same_as", STATION_COL, "seq")


@register("scope_visible")
def scope_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 counted for every access record."""
    return stations.visible_counts(_accepted_stations(spark, sf_dir), _migrated(spark, sf_dir))


@register("scope_endpoints")
def scope_endpoints_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records allowed on each endpoint."""
    sc, out = fixtures.scopes(spark, sf_dir), None
    for name in ("view", "click", "signup", "error"):
        endpoint = fixtures.EVENT_ENDPOINTS[name]
        rows = stations.scope_endpoints(sc, endpoint).select("ordinal", F.lit(endpoint).alias("endpoint"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("scope_endpoint_flags")
def scope_endpoint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = fixtures.scopes(spark, sf_dir)
    names = {
        "allowed_current": fixtures.EVENT_ENDPOINTS["view"],
        "allowed_range": fixtures.EVENT_ENDPOINTS["click"],
        "allowed_ws": fixtures.EVENT_ENDPOINTS["signup"],
        "allowed_storage": fixtures.EVENT_ENDPOINTS["error"],
    }
    return sc.select("ordinal", *[stations.allows_endpoint(F.col("endpoints"), n).alias(a)
                                  for a, n in names.items()])


@register("allowlist_insert")
def allowlist_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fixtures.load(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    key = fixtures.station_key(F.col("user_id"))
    new = ev.select(
        (F.lit(NEW_STATION_ORDINAL_BASE) + F.col("event_id")).alias("ordinal"),
        F.concat(F.lit("new station "), F.col("user_id").cast("string")).alias("title"),
        F.concat(F.lit(fixtures.STATION_HASH_PREFIX + "600000$"),
                 F.substring(F.sha2(F.concat(F.lit("salt"), F.col("event_id").cast("string")), 256), 1, 32),
                 F.lit("$"), F.sha2(key, 256)).alias("salted_station_hash"),
        stations.passkey_digest(key, fixtures.PEPPER).alias("passkey_digest"),
    )
    return stations.insert_stations(fixtures.stations(spark, sf_dir), new)


@register("split_csv")
def split_csv_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fixtures.load(spark, sf_dir, "events")
    text = F.concat(F.col("event_type"), F.lit(", ,"), F.lit(" k"),
                    F.get_json_object("props", "$.k"), F.lit(",, "), F.col("user_id").cast("string"))
    items = split_csv(text)
    return ev.select("event_id", F.array_join(items, "|").alias("items"),
                     F.size(items).cast("bigint").alias("n_items"))


# --- A11 ------------------------------------------------------------------------

@register("usage_status")
def usage_status_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of reports per station against thresholds."""
    from stationlake.operators.usage import report_usage

    rep = with_form(fixtures.reports(spark, sf_dir))
    return report_usage(rep, F.col("form")["PASSKEY"], F.col("body"), USAGE_WARNING_GB, USAGE_ERROR_GB)


# --- what is written and read again: S1, S7, S8, K1-K3, A9, ST1-ST3, ST6 ----------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/query-{name}-{uuid.uuid4().hex}"


@register("report_log")
def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture log, written and read as its source reads it."""
    path = _folder(spark, "log")
    fixtures.report_log(spark, sf_dir).write.json(path)
    logged = with_log_columns(read_reports(spark, path))
    f = F.col("form")
    return logged.select(F.col("received").alias("event_id"), f["PASSKEY"].alias("PASSKEY"), f["tempf"].alias("tempf"),
                         f["model"].alias("model"), f["freq"].alias("freq"), f["uv"].alias("uv"))


@register("registry_stations")
def registry_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allow-list as a folder of JSON lines."""
    path = _folder(spark, "stations")
    (fixtures.stations(spark, sf_dir).repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal")
     .drop("ordinal").write.json(path))
    return read_stations(spark, path)


@register("registry_scopes")
def registry_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access records as a folder of JSON lines."""
    path = _folder(spark, "scopes")
    (fixtures.scopes(spark, sf_dir).repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal")
     .drop("ordinal").write.json(path))
    return read_scopes(spark, path).select("ordinal", "title", F.array_join("endpoints", ",").alias("endpoints"),
                                           F.array_join("weatherstations", ",").alias("weatherstations"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A store whose raw table was written by two upserts, the second of corrections."""
    base = _folder(spark, "store")
    aligned = ingest.align(_readings(spark, sf_dir), raw_schema(), keep=["seq"])
    tables.upsert(spark, aligned, base)
    tables.upsert(spark, corrections(aligned), base)
    return base


@register("stored_raw")
def stored_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, S3: upserts into the raw table, read back whole."""
    return read_all(spark, _stored(spark, sf_dir))


@register("stored_rollups")
def stored_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour rollup that `recompute_rollups` writes, with the other granularities, from raw."""
    base = _stored(spark, sf_dir)
    tables.recompute_rollups(spark, base)
    fields = [f for f in AGGREGATABLE_FIELDS if f in READING_COLUMNS]
    return round_stats(read_all(spark, base, "1h").select(
        TIMESTAMP_COL, STATION_COL, "sample_count", *[stat_column(f, s) for f in fields for s in ROLLUP_STATS]))


@register("csv_export")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a range as CSV, and its parts read back by the schema."""
    path = _folder(spark, "csv")
    aligned = ingest.align(_readings(spark, sf_dir).drop("seq"), raw_schema())
    tables.export_csv(range_of("raw", aligned, RANGE_START, RANGE_END).orderBy(TIMESTAMP_COL), path)
    return spark.read.schema(raw_schema()).option("pathGlobFilter", "part-*").csv(path)


@register("stream_ingest")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1-ST3, ST6, K4, K5: the report log through the stream's batches.

    Two batches by the parity of the arrival number, a compaction, and the last
    batch replayed after it was folded.  The rows: what became of each report
    (the stored reading, or why it was refused), the day rollups that the
    stream keeps by merging states, and the newest message of every channel."""
    base = _folder(spark, "stream")
    fixtures.report_log(spark, sf_dir).write.partitionBy("part").json(f"{base}/source")
    listed = f"{base}/stations"
    (fixtures.stations(spark, sf_dir).repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal")
     .drop("ordinal").write.json(listed))
    batches = [read_reports(spark, f"{base}/source/part={part}") for part in (0, 1)]
    for batch_id, batch in enumerate(batches):
        stream.process_batch(spark, batch, batch_id, base, listed, fixtures.PEPPER)
    stream.compact(spark, base)
    stream.process_batch(spark, batches[1], 1, base, listed, fixtures.PEPPER)

    shape = {"kind": "string", "event_id": "bigint", STATION_COL: "string", TIMESTAMP_COL: "timestamp_ntz",
             "tempf": "double", "reject_reason": "string", "batch": "bigint", "sample_count": "bigint",
             **{stat_column(f, s): "double" for f in ("tempf", "thi") for s in ROLLUP_STATS}}

    def rows(df: DataFrame, **columns: Column | str) -> DataFrame:
        given = {k: F.col(c) if isinstance(c, str) else c for k, c in columns.items()}
        return df.select(*[given.get(k, F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k)
                           for k, t in shape.items()])
    view = read_view(spark, base)
    stored = rows(stream.current_raw(spark, view), kind=F.lit("stored"), event_id="seq")
    refused = rows(stream.read_rejects(spark, base, view).drop("batch"), kind=F.lit("refused"),
                   event_id=F.unix_micros(F.col("received_text").cast("timestamp")))
    days = rows(round_stats(stream.current_rollup(spark, view, "1d")), kind=F.lit("1d"))
    feed = rows(stream.latest_feed(spark, base, view), kind=F.concat(F.lit("feed "), "data_type"),
                **{c: F.get_json_object("payload", f"$.{c}") for c in ("tempf", "sample_count", "tempf_max")})
    return stored.unionByName(refused).unionByName(days).unionByName(feed)
