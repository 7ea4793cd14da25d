"""Station data derived from the driver tables.

Only ``events`` looks like a sensor feed, so every station-side table is a
projection of it (all work grows with ``events``):

readings  one reading per event: station ``st_<user_id>``, ``timestamp = ts``,
          ``seq = event_id``, the ``k`` of ``props`` as humidity, and sensor
          values as simple functions of ``value``; ``wide_readings`` has all
          23 numeric report fields.
reports   the same events as urlencoded station reports with every field, and
          the raw station key ``PK<user_id>``; some are broken on purpose, some
          repeat a field, and some come a second time with another value.
stations  the allow-list: one entry per ``signup`` event of two users in
          three, so a user with several is listed several times (first entry
          wins) and every third user is an unknown station.
scopes    one access record per user, with titles that repeat: endpoints from
          the event types used, stations from the ``k`` values seen (raw keys,
          the pre-migration form) or the own station, a wildcard for users with
          a large purchase, and no station at all for some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.text import apart, with_form
from stationlake.operators.metric import to_metric
from stationlake.schema import NUMERIC_PAYLOAD_FIELDS, STATION_COL, TIMESTAMP_COL

# --- Fixed values: fixture rules -------------------------------------------
# Sensor values as functions of the event value v and the props key k.
#   tempf = 20 + v % 90, baromrelin = 29 + v / 1000, windspeedmph = v / 10,
#   rainratein = v / 100, vpd = v / 500, humidity = k, winddir = k * 3.6
# Report breakage by event type:
#   error  -> tempf is 'not-a-number'         (invalid number)
#   view with k = 0 -> no dateutc             (missing time)
#   click with k = 0 -> no PASSKEY            (missing key)
# Endpoint granted per event type in a user's history.
EVENT_ENDPOINTS: dict[str, str] = {
    "view": "/data/{station_id}/{data_type}/current",
    "click": "/data/{station_id}/{data_type}/range",
    "signup": "/ws/{station_id}/{data_type}",
    "error": "/storage/status",
    "purchase": "*",
}
WILDCARD_PURCHASE_VALUE = 300.0
# The other report fields, in hundredths of c (the value in hundredths):
# field = (offset + (c * factor) % modulus) / 100.
CENT_FIELDS: dict[str, tuple[int, int, int]] = {
    "runtime": (100, 7, 900000), "heap": (500, 11, 70000), "tempinf": (6000, 3, 3000), "humidityin": (3000, 5, 4000),
    "baromabsin": (2800, 1, 300), "windgustmph": (100, 2, 6000), "solarradiation": (0, 13, 90000), "uv": (0, 1, 1200),
    "rainratein": (0, 1, 300), "eventrainin": (0, 2, 500), "dailyrainin": (0, 3, 700), "weeklyrainin": (0, 4, 1100),
    "monthlyrainin": (0, 5, 1300), "yearlyrainin": (0, 6, 1700), "totalrainin": (0, 7, 1900), "vpd": (20, 1, 90),
    "wh65batt": (0, 1, 2), "interval": (3000, 1, 100),
}
# By event id modulo 50, a report ends with
#   7 -> a second model with a broken escape, 8 -> a blank freq,
#   9 -> a second uv that overflows (invalid number), 10 -> a second tempf;
# and 11 -> the report is sent again later, with tempf 50.
REPEATED = 11
REPEAT_ID = 1_000_000_000_000
# Part of every station-key digest here.
PEPPER = "fixture pepper:"
STATION_HASH_PREFIX = "pbkdf2_sha256$"
# ---------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _thin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, dealt to all cores where the table is a single file.

    A file of one row group is read by one task, which would then also build
    and decode every report; here only the thin events are shuffled.  A
    table of many files has splits enough and is read as it is."""
    ev = load(spark, sf_dir, "events")
    if len(ev.inputFiles()) > 1:
        return ev
    return ev.repartition(spark.sparkContext.defaultParallelism, "event_id")


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("double")


def readings(spark: SparkSession, sf_dir: str, metric: bool = True) -> DataFrame:
    """Readings view over ``events`` (already typed, one per event)."""
    ev = load(spark, sf_dir, "events")
    v = F.col("value")
    k = _k(F.col("props"))
    df = ev.select(
        F.concat(F.lit("st_"), F.col("user_id").cast("string")).alias(STATION_COL),
        F.col("ts").alias(TIMESTAMP_COL),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stationtype"),
        k.alias("humidity"),
        (F.lit(20.0) + v % F.lit(90.0)).alias("tempf"),
        (F.lit(29.0) + v / F.lit(1000.0)).alias("baromrelin"),
        (v / F.lit(10.0)).alias("windspeedmph"),
        (v / F.lit(100.0)).alias("rainratein"),
        (v / F.lit(500.0)).alias("vpd"),
        (k * F.lit(3.6)).alias("winddir"),
    )
    return to_metric(df) if metric else df


def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with all 23 numeric report fields and every metric field."""
    base = load(spark, sf_dir, "events")
    v, k, c = F.col("value"), _k(F.col("props")), report_cents(F.col("value"))
    own = {"humidity": k, "tempf": F.lit(20.0) + v % F.lit(90.0), "baromrelin": F.lit(29.0) + v / F.lit(1000.0),
           "windspeedmph": v / F.lit(10.0), "winddir": k * F.lit(3.6)}
    cents = {n: (F.lit(off) + (c * factor) % mod) / F.lit(100.0) for n, (off, factor, mod) in CENT_FIELDS.items()}
    return to_metric(base.select(
        F.concat(F.lit("st_"), F.col("user_id").cast("string")).alias(STATION_COL),
        F.col("ts").alias(TIMESTAMP_COL), F.col("event_id").alias("seq"), F.col("event_type").alias("stationtype"),
        *[(own | cents)[n].alias(n) for n in NUMERIC_PAYLOAD_FIELDS]))


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings keyed by (station, day): several per key, so upserts matter."""
    df = readings(spark, sf_dir)
    return df.withColumn(TIMESTAMP_COL, F.to_date(TIMESTAMP_COL).cast("timestamp_ntz"))


def station_key(user_id: Column) -> Column:
    """Raw station key (the secret a station sends as PASSKEY)."""
    return F.concat(F.lit("PK"), user_id.cast("string"))


def _cents_text(cents: Column) -> Column:
    """Text of an integer number of hundredths: 7553 -> '75.53'.

    Built from integers so every engine prints the same digits.
    """
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def report_cents(value: Column) -> Column:
    """The event value in hundredths (values carry two decimals)."""
    return F.round(value * F.lit(100.0)).cast("bigint")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urlencoded report bodies: (event_id, received, body).

    ``received`` is the arrival order used for latest-wins (the event id; a
    report sent again has an id of its own).  Numbers are printed from
    integers: tempf = (2000 + c % 9000) / 100, baromrelin = 29 +
    (c % 1000) / 1000, windspeedmph = c / 100 and the rest by `CENT_FIELDS`,
    with c the value in hundredths.
    """
    ev = _thin_events(spark, sf_dir).withColumn("again", F.explode(F.when(
        F.col("event_id") % 50 == REPEATED, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    c = report_cents(F.col("value"))
    k = F.get_json_object(F.col("props"), "$.k")
    etype = F.col("event_type")
    dateutc = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    tempf = F.when(etype == "error", F.lit("not-a-number")).when(F.col("again"), F.lit("50.00")).otherwise(
        _cents_text(F.lit(2000) + c % 9000))
    kind = F.col("event_id") % 50
    pairs = [
        F.when(~((etype == "click") & (k == "0")),
               F.concat(F.lit("PASSKEY="), station_key(F.col("user_id")))),
        F.concat(F.lit("stationtype="), F.url_encode(F.concat(F.lit("Station "), etype))),
        F.when(~((etype == "view") & (k == "0")),
               F.concat(F.lit("dateutc="), F.url_encode(dateutc))),
        F.concat(F.lit("tempf="), tempf),
        F.concat(F.lit("humidity="), k),
        F.concat(F.lit("winddir="), k),
        F.concat(F.lit("baromrelin=29."), F.lpad((c % 1000).cast("string"), 3, "0")),
        F.concat(F.lit("windspeedmph="), _cents_text(c)),
        *[F.concat(F.lit(f"{name}="), _cents_text(F.lit(off) + (c * factor) % mod))
          for name, (off, factor, mod) in CENT_FIELDS.items()],
        F.lit("freq=868M"),
        F.concat(F.lit("model="), F.url_encode(F.lit("WX-1000 V1.0"))),
        F.when(kind == 7, F.lit("model=50%+%41%4")).when(kind == 8, F.lit("freq=")).when(kind == 9, F.lit("uv=1e999"))
         .when((kind == 10) & (etype != "error"), F.lit("tempf=60.00")),
    ]
    arrival = F.col("event_id") + F.when(F.col("again"), F.lit(REPEAT_ID)).otherwise(F.lit(0))
    return ev.select(arrival.alias("event_id"), apart(arrival).alias("received"), F.concat_ws("&", *pairs).alias("body"))


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as a capture log (S1 shape), with ``part``: the parity of
    the arrival number, by which tests make batches.  The capture time is
    the arrival number in microseconds."""
    rep = with_form(reports(spark, sf_dir))
    at = F.timestamp_add("MICROSECOND", F.col("received"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return rep.select(
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
        F.lit("10.0.0.2").alias("client_ip"), F.lit("POST").alias("method"), F.lit("/data/report/").alias("path"),
        F.col("form").alias("body"), (F.col("received") % 2).cast("int").alias("part"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list entries (S7 shape) plus the registration-time digest.

    Columns: ordinal, title, salted_station_hash, passkey_digest.  The
    digest is what a registration job stores next to the salted hash so
    that reports resolve by an equi-join (see operators/stations.py).
    """
    from stationlake.operators.stations import passkey_digest

    ev = load(spark, sf_dir, "events").filter((F.col("event_type") == "signup") & (F.col("user_id") % 3 != 0))
    key = station_key(F.col("user_id"))
    return ev.select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("station "), F.col("user_id").cast("string"), F.lit(" #"),
                 F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit(STATION_HASH_PREFIX + "600000$"),
                 F.substring(F.sha2(F.concat(F.lit("salt"), F.col("event_id").cast("string")), 256), 1, 32),
                 F.lit("$"), F.sha2(key, 256)).alias("salted_station_hash"),
        passkey_digest(key, PEPPER).alias("passkey_digest"),
    )


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access records (S8 shape): ordinal, title, endpoints, weatherstations.

    The ordinal is the user; five titles are shared by all, and so are
    endpoint lists.  Arrays are bounded: endpoints by the five event types,
    stations by the 100 distinct ``k`` values plus the wildcard, in the order
    of the first event that granted them.  Every seventh user has no station.
    """
    ev = load(spark, sf_dir, "events")
    endpoint = F.create_map(*[x for kv in EVENT_ENDPOINTS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    station_ref = F.when(
        (F.col("event_type") == "purchase") & (F.col("value") > F.lit(WILDCARD_PURCHASE_VALUE)), F.lit("*"),
    ).when(F.col("user_id") % 4 == 1, station_key(F.col("user_id"))).otherwise(
        station_key(F.get_json_object(F.col("props"), "$.k")))
    grants = ev.select("user_id", "event_id", endpoint[F.col("event_type")].alias("endpoint"),
                       station_ref.alias("station"))
    per_station = grants.groupBy("user_id", "station").agg(F.min("event_id").alias("first"),
                                                           F.collect_set("endpoint").alias("e"))
    users = per_station.groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("endpoints"),
        F.sort_array(F.collect_list(F.struct("first", "station"))).alias("s"))
    none = F.array().cast("array<string>")
    return users.select(
        F.col("user_id").alias("ordinal"),
        F.concat(F.lit("key "), (F.col("user_id") % 5).cast("string")).alias("title"), "endpoints",
        F.when(F.col("user_id") % 7 == 0, none).otherwise(F.transform("s", lambda x: x["station"]))
        .alias("weatherstations"))


def passkey_digest_of(key: str) -> Column:
    """Allow-list digest of one raw station key (for registry files)."""
    from stationlake.operators.stations import passkey_digest

    return passkey_digest(F.lit(key), PEPPER)
