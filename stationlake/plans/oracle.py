"""DuckDB SQL for each registered query (the correctness oracle).

The SQL restates each query from the driver tables, independently of the
Spark code: the readings view, the rollups (mode by an explicit ranking, as
DuckDB's ``mode()`` breaks ties differently), the joins and the parsers.
Averages and standard deviations are rounded to 9 decimals on both sides (summation order
differs; 9 places sit far above that noise and below the ties that short
decimal inputs produce at 6 or 7 places).
"""

from __future__ import annotations

from stationlake.schema import AGGREGATABLE_FIELDS, ROLLUP_STATS, raw_schema

# Fields of the readings view, in rollup column order.
READING_FIELDS = [
    "baromrelin", "tempf", "humidity", "winddir", "windspeedmph", "rainratein", "vpd",
    "temp_c", "baromrel_hpa", "windspeed_ms", "rainrate_mm", "vpd_kpa", "thi",
]

_D = "::DOUBLE"

READINGS_SQL = f"""
SELECT 'st_' || CAST(user_id AS VARCHAR) AS PASSKEY, ts AS "timestamp", event_id AS seq,
       event_type AS stationtype, humidity, tempf, baromrelin, windspeedmph, rainratein, vpd, winddir,
       (tempf - 32.0{_D}) / 1.8{_D} AS temp_c,
       baromrelin * 33.86388640341{_D} AS baromrel_hpa,
       windspeedmph * 0.44704{_D} AS windspeed_ms,
       rainratein * 25.4{_D} AS rainrate_mm,
       vpd * 3.386388640341{_D} AS vpd_kpa,
       (1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) + 32.0{_D})
         - ((0.55{_D} - 0.0055{_D} * humidity) * (1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) - 26.0{_D})) AS thi
FROM (
  SELECT user_id, ts, event_id, event_type,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
         20.0{_D} + value % 90.0{_D} AS tempf,
         29.0{_D} + value / 1000.0{_D} AS baromrelin,
         value / 10.0{_D} AS windspeedmph,
         value / 100.0{_D} AS rainratein,
         value / 500.0{_D} AS vpd,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.6{_D} AS winddir
  FROM events
) e
"""

RAW_COLUMNS = ["timestamp", "PASSKEY", "seq", "stationtype"] + READING_FIELDS

_TRUNC = {"1m": "minute", "1h": "hour", "1d": "day"}


def rollup_sql(interval: str, source_sql: str = READINGS_SQL,
               fields: list[str] | None = None) -> str:
    """Rollup of ``source_sql`` (needs PASSKEY, timestamp and the fields)."""
    fields = fields or READING_FIELDS
    unit = _TRUNC[interval]
    stat_cols = []
    for f in fields:
        stat_cols += [
            f'ROUND(avg("{f}"), 9) AS "{f}_avg"',
            f'min("{f}") AS "{f}_min"',
            f'max("{f}") AS "{f}_max"',
            f'ROUND(stddev_samp("{f}"), 9) AS "{f}_std"',
        ]
    ctes = [f"r AS ({source_sql})",
            f"""b AS (SELECT *, date_trunc('{unit}', "timestamp") AS bkt FROM r)""",
            f"""s AS (SELECT PASSKEY, bkt, count(*) AS sample_count, {", ".join(stat_cols)}
                     FROM b GROUP BY PASSKEY, bkt)"""]
    joins = []
    for i, f in enumerate(fields):
        ctes.append(f"""m{i} AS (
          SELECT PASSKEY, bkt, v AS "{f}_mode" FROM (
            SELECT PASSKEY, bkt, "{f}" AS v,
                   row_number() OVER (PARTITION BY PASSKEY, bkt ORDER BY count(*) DESC, "{f}") AS rn
            FROM b WHERE "{f}" IS NOT NULL GROUP BY PASSKEY, bkt, "{f}") t WHERE rn = 1)""")
        joins.append(f"LEFT JOIN m{i} ON s.PASSKEY = m{i}.PASSKEY AND s.bkt = m{i}.bkt")
    cols = ['s.bkt AS "timestamp"', "s.PASSKEY", "s.sample_count"]
    for i, f in enumerate(fields):
        for st in ROLLUP_STATS:
            cols.append(f'm{i}."{f}_mode"' if st == "mode" else f's."{f}_{st}"')
    return (f"WITH {', '.join(ctes)}\nSELECT {', '.join(cols)}\nFROM s\n" + "\n".join(joins))



READING_COLUMNS = ['"timestamp"', "PASSKEY", "seq", "stationtype"] + READING_FIELDS


def _readings_cols(sql: str = READINGS_SQL) -> str:
    return f"SELECT {', '.join(READING_COLUMNS)} FROM ({sql}) r0"


def aligned_sql(source: str = READINGS_SQL, where: str = "") -> str:
    """The readings in the 43-column raw schema, absent columns typed null."""
    have = set(READING_FIELDS) | {"timestamp", "PASSKEY", "stationtype"}
    cols = []
    for f in raw_schema().fields:
        if f.name in have:
            cols.append(f'"{f.name}"')
        else:
            typ = "VARCHAR" if f.dataType.simpleString() == "string" else "DOUBLE"
            cols.append(f'CAST(NULL AS {typ}) AS "{f.name}"')
    return f"SELECT {', '.join(cols)} FROM ({source}) a0 {where}"


# Events with the props key and the value in hundredths.
EV = """SELECT event_id, ts, user_id, event_type, value,
               json_extract_string(props, '$.k') AS k,
               CAST(round(value * 100.0) AS BIGINT) AS c
        FROM events"""

# The report fields given in hundredths: name -> SQL of the hundredths.
CENTS = {
    "runtime": "100 + (c * 7) % 900000", "heap": "500 + (c * 11) % 70000", "tempinf": "6000 + (c * 3) % 3000",
    "humidityin": "3000 + (c * 5) % 4000", "baromabsin": "2800 + c % 300", "windgustmph": "100 + (c * 2) % 6000",
    "solarradiation": "(c * 13) % 90000", "uv": "c % 1200", "rainratein": "c % 300", "eventrainin": "(c * 2) % 500",
    "dailyrainin": "(c * 3) % 700", "weeklyrainin": "(c * 4) % 1100", "monthlyrainin": "(c * 5) % 1300",
    "yearlyrainin": "(c * 6) % 1700", "totalrainin": "(c * 7) % 1900", "vpd": "20 + c % 90", "wh65batt": "c % 2",
    "interval": "3000 + c % 100",
}


def _cents_text(expr: str) -> str:
    return f"(CAST(({expr}) // 100 AS VARCHAR) || '.' || lpad(CAST(({expr}) % 100 AS VARCHAR), 2, '0'))"


def _cents(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / 100.0{_D}"


# The reports as a station would have sent them, field by field; every 50th
# event's report comes again with another temperature, and others carry a
# trailing pair that repeats a key.
REP = f"""SELECT *,
  concat_ws('&', 'PASSKEY=' || PASSKEY, 'stationtype=Station+' || event_type,
    'dateutc=' || replace(replace(dateutc, ' ', '+'), ':', '%3A'), 'tempf=' || first_tempf, 'humidity=' || k, 'winddir=' || k,
    'baromrelin=29.' || lpad(CAST(c % 1000 AS VARCHAR), 3, '0'), 'windspeedmph=' || {_cents_text('c')},
    {', '.join(f"'{n}=' || {_cents_text(e)}" for n, e in CENTS.items())},
    'freq=868M', 'model=WX-1000+V1.0',
    CASE WHEN kind = 7 THEN 'model=50%+%41%4' WHEN kind = 8 THEN 'freq=' WHEN kind = 9 THEN 'uv=1e999'
         WHEN kind = 10 AND event_type <> 'error' THEN 'tempf=60.00' END) AS body,
  CASE WHEN kind = 7 THEN '50% A%4' ELSE 'WX-1000 V1.0' END AS model,
  CASE WHEN kind = 8 THEN '' ELSE '868M' END AS freq,
  CASE WHEN kind = 9 THEN '1e999' ELSE {_cents_text(CENTS['uv'])} END AS uv_text,
  CASE WHEN kind = 10 AND event_type <> 'error' THEN '60.00' ELSE first_tempf END AS tempf_text,
  concat_ws(',', CASE WHEN event_type = 'error' THEN 'tempf' END, CASE WHEN kind = 9 THEN 'uv' END) AS invalid
FROM (SELECT event_id + again * 1000000000000 AS event_id, event_id % 50 AS kind, ts, user_id, event_type, k, c,
  CASE WHEN event_type = 'click' AND k = '0' THEN NULL ELSE 'PK' || CAST(user_id AS VARCHAR) END AS PASSKEY,
  'Station ' || event_type AS stationtype,
  CASE WHEN event_type = 'view' AND k = '0' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS dateutc,
  CASE WHEN event_type = 'error' THEN 'not-a-number' WHEN again = 1 THEN '50.00'
       ELSE {_cents_text('2000 + c % 9000')} END AS first_tempf
FROM ({EV}) e JOIN (VALUES (0), (1)) a(again) ON again = 0 OR event_id % 50 = 11) r0"""

# Typed report fields; null where the text is no finite number.
REP_FIELDS = {n: _cents(e) for n, e in CENTS.items()} | {
    "uv": f"CASE WHEN kind <> 9 THEN {_cents(CENTS['uv'])} END",
    "tempf": "TRY_CAST(tempf_text AS DOUBLE)", "humidity": "CAST(k AS DOUBLE)", "winddir": "CAST(k AS DOUBLE)",
    "baromrelin": f"CAST(29000 + c % 1000 AS DOUBLE) / 1000.0{_D}", "windspeedmph": _cents("c"),
}

# Metric fields from their sources.
METRIC = {
    "temp_c": f"(tempf - 32.0{_D}) / 1.8{_D}", "tempin_c": f"(tempinf - 32.0{_D}) / 1.8{_D}",
    "baromrel_hpa": f"baromrelin * 33.86388640341{_D}", "baromabs_hpa": f"baromabsin * 33.86388640341{_D}",
    "windspeed_ms": f"windspeedmph * 0.44704{_D}", "windgust_ms": f"windgustmph * 0.44704{_D}",
    "rainrate_mm": f"rainratein * 25.4{_D}", "eventrain_mm": f"eventrainin * 25.4{_D}",
    "dailyrain_mm": f"dailyrainin * 25.4{_D}", "weeklyrain_mm": f"weeklyrainin * 25.4{_D}",
    "monthlyrain_mm": f"monthlyrainin * 25.4{_D}", "yearlyrain_mm": f"yearlyrainin * 25.4{_D}",
    "totalrain_mm": f"totalrainin * 25.4{_D}", "vpd_kpa": f"vpd * 3.386388640341{_D}",
    "thi": f"(1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) + 32.0{_D}) - ((0.55{_D} - 0.0055{_D} * humidity)"
           f" * (1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) - 26.0{_D}))",
}


def _with_metric(source: str) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in METRIC.items())} FROM ({source}) m0"


# Readings with every numeric report field.
WIDE_FIELDS = {n: _cents(e) for n, e in CENTS.items()} | {
    "humidity": "CAST(k AS DOUBLE)", "tempf": f"20.0{_D} + value % 90.0{_D}", "baromrelin": f"29.0{_D} + value / 1000.0{_D}",
    "windspeedmph": f"value / 10.0{_D}", "winddir": f"CAST(k AS DOUBLE) * 3.6{_D}",
}
WIDE_SQL = _with_metric(f"""SELECT 'st_' || CAST(user_id AS VARCHAR) AS PASSKEY, ts AS "timestamp", event_id AS seq,
  event_type AS stationtype, {', '.join(f'{e} AS "{n}"' for n, e in WIDE_FIELDS.items())} FROM ({EV}) e""")

STATION_HASH = ("'pbkdf2_sha256$600000$' || substr(sha256('salt' || CAST({eid} AS VARCHAR)), 1, 32)"
                " || '$' || sha256('PK' || CAST({uid} AS VARCHAR))")

ST = f"""SELECT event_id AS ordinal, user_id,
  'station ' || CAST(user_id AS VARCHAR) || ' #' || CAST(event_id AS VARCHAR) AS title,
  {STATION_HASH.format(eid='event_id', uid='user_id')} AS salted_station_hash,
  sha256('fixture pepper:PK' || CAST(user_id AS VARCHAR)) AS passkey_digest
FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0"""

FIRST_ST = f"SELECT user_id, arg_min(salted_station_hash, ordinal) AS station_id FROM ({ST}) s GROUP BY user_id"

# Scope entries after migration: one row per (user, station reference).
SCOPE_RES = f"""WITH g AS (
  SELECT user_id, event_id,
         CASE WHEN event_type = 'purchase' AND value > 300.0 THEN '*'
              WHEN user_id % 4 = 1 THEN 'PK' || CAST(user_id AS VARCHAR) ELSE 'PK' || k END AS station
  FROM ({EV}) e WHERE user_id % 7 <> 0),
sref AS (SELECT user_id, station, min(event_id) AS first FROM g GROUP BY user_id, station)
SELECT s.user_id, s.station, s.first,
  CASE WHEN s.station = '*' OR starts_with(s.station, 'pbkdf2_sha256$') THEN s.station
       ELSE coalesce(f.station_id, s.station) END AS v,
  (s.station <> '*' AND NOT starts_with(s.station, 'pbkdf2_sha256$') AND f.station_id IS NULL) AS bad
FROM sref s LEFT JOIN ({FIRST_ST}) f ON s.station = 'PK' || CAST(f.user_id AS VARCHAR)"""

# One row per record: all users, with the migrated list where there is one.
MIGRATED = f"""SELECT u.user_id AS ordinal, 'key ' || CAST(u.user_id % 5 AS VARCHAR) AS title,
  coalesce(string_agg(s.v, ',' ORDER BY s.first), '') AS weatherstations,
  coalesce(string_agg(CASE WHEN s.bad THEN s.station END, ',' ORDER BY s.first), '') AS unresolved,
  CAST(count(*) FILTER (WHERE s.bad) AS BIGINT) AS n_unresolved
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ({SCOPE_RES}) s USING (user_id) GROUP BY u.user_id"""

ACCEPTED = f"""SELECT r.*, f.station_id FROM ({REP}) r JOIN ({FIRST_ST}) f ON r.user_id = f.user_id
  WHERE r.PASSKEY IS NOT NULL AND r.dateutc IS NOT NULL AND r.invalid = ''"""

STORED = _with_metric(f"""SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS "timestamp", station_id AS PASSKEY,
  stationtype, freq, model, event_id AS seq, {', '.join(f'{e} AS "{n}"' for n, e in REP_FIELDS.items())}
FROM ({ACCEPTED}) a QUALIFY row_number() OVER (PARTITION BY station_id, date_trunc('second', ts) ORDER BY event_id DESC) = 1""")


_FEED_STATS = [f"{f}_{st}" for f in READING_FIELDS for st in ROLLUP_STATS]


def _feed_part(interval: str) -> str:
    """The rollup rows that hold each station's newest reading."""
    unit = _TRUNC[interval]
    return f"""SELECT '{interval}' AS data_type, q.PASSKEY, q."timestamp", q.sample_count,
         {', '.join(f'q."{c}"' for c in _FEED_STATS)}
  FROM ({rollup_sql(interval)}) q
  JOIN (SELECT PASSKEY, date_trunc('{unit}', max("timestamp")) AS b FROM ({READINGS_SQL}) x GROUP BY PASSKEY) m
    ON q.PASSKEY = m.PASSKEY AND q."timestamp" = m.b"""


_FEED_RAW = ", ".join(f'ROUND("{f}", 9) AS "{f}_avg", ' + ", ".join(
    f'CAST(NULL AS DOUBLE) AS "{f}_{st}"' for st in ROLLUP_STATS[1:]) for f in READING_FIELDS)


# The readings after the corrections.
CORRECTED_SQL = f"""SELECT * REPLACE (seq + 1000000000000 * (seq % 50 = 10)::INT AS seq, tempf + (seq % 50 = 10)::INT::DOUBLE AS tempf)
  FROM ({READINGS_SQL}) r"""

# Rejected reports and why.
REJECTED = f"""SELECT event_id, reject_reason FROM (
        SELECT r.event_id,
          CASE WHEN r.PASSKEY IS NULL THEN 'missing PASSKEY'
               WHEN f.station_id IS NULL THEN 'unknown station'
               WHEN r.dateutc IS NULL THEN 'missing dateutc'
               WHEN r.invalid <> '' THEN 'invalid number: ' || r.invalid END AS reject_reason
        FROM ({REP}) r LEFT JOIN ({FIRST_ST}) f ON r.user_id = f.user_id) x
      WHERE reject_reason IS NOT NULL"""


def _stream_channel(interval: str) -> str:
    """The last bucket of each station, as the last batch that touched it left it."""
    unit = _TRUNC[interval]
    return f"""SELECT '{interval}' AS data_type, s.PASSKEY, date_trunc('{unit}', s."timestamp")::TIMESTAMP AS "timestamp",
        any_value(n.batch) AS batch, count(*) AS sample_count, NULL::DOUBLE AS tempf, max(s.tempf) AS tempf_max
      FROM stored s JOIN newest n ON n.PASSKEY = s.PASSKEY
        AND date_trunc('{unit}', s."timestamp") = date_trunc('{unit}', n.last) GROUP BY 2, 3"""


ORACLE: dict[str, str] = {
    "rollup_1m": rollup_sql("1m"),
    "rollup_1h": rollup_sql("1h"),
    "rollup_1d": rollup_sql("1d"),
    "rollup_wide": rollup_sql("1d", WIDE_SQL, fields=AGGREGATABLE_FIELDS),
    "rollup_bounded": rollup_sql("1d", WIDE_SQL, fields=AGGREGATABLE_FIELDS),
    "form_decode": f"""SELECT event_id, PASSKEY, stationtype, dateutc, tempf_text AS tempf, k AS humidity,
        model, freq, uv_text AS uv,
        CAST(28 - (CASE WHEN PASSKEY IS NULL THEN 1 ELSE 0 END)
                - (CASE WHEN dateutc IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_keys
      FROM ({REP}) r""",
    "typed_reports": f"""SELECT event_id, PASSKEY, stationtype,
        CASE WHEN dateutc IS NULL THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS dateutc,
        {', '.join(f'{e} AS "{n}"' for n, e in REP_FIELDS.items())},
        freq, model, invalid AS invalid_fields
      FROM ({REP}) r""",
    "ingest_accepted": f"""SELECT seq, {', '.join(f'"{f.name}"' for f in raw_schema().fields)} FROM ({STORED}) s""",
    "parse_times": """SELECT event_id,
        CAST(date_trunc('second', ts) AS TIMESTAMP) AS dateutc_std,
        CAST(date_trunc('second', ts) AS TIMESTAMP) AS dateutc_unpadded,
        CAST(NULL AS TIMESTAMP) AS dateutc_t,
        CAST(NULL AS TIMESTAMP) AS dateutc_bad,
        ts AS iso_z,
        CAST(date_trunc('second', ts) AS TIMESTAMP) AS iso_offset,
        CAST(date_trunc('second', ts) AS TIMESTAMP) AS iso_naive,
        CAST(date_trunc('day', ts) AS TIMESTAMP) AS iso_date,
        CAST(NULL AS TIMESTAMP) AS iso_bad
      FROM events""",
    "rejected_reports": REJECTED,
    "to_metric": WIDE_SQL,
    "unit_functions": f"""SELECT seq,
        windspeedmph * 1.609344{_D} AS windspeed_kmh,
        windspeedmph * 0.44704{_D} AS windspeed_ms,
        baromrelin * 33.86388640341{_D} AS barom_hpa,
        baromrelin * 3.386388640341{_D} AS barom_kpa,
        rainratein * 25.4{_D} AS rain_mm,
        (tempf - 32.0{_D}) / 1.8{_D} AS temp_c
      FROM ({READINGS_SQL}) r""",
    "thi": f"""SELECT seq, temp_c, rh AS humidity,
        (1.8{_D} * temp_c + 32.0{_D}) - ((0.55{_D} - 0.0055{_D} * rh) * (1.8{_D} * temp_c - 26.0{_D})) AS thi,
        (1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) + 32.0{_D})
          - ((0.55{_D} - 0.0055{_D} * rh) * (1.8{_D} * ((tempf - 32.0{_D}) / 1.8{_D}) - 26.0{_D})) AS thi_from_f,
        (1.8{_D} * ((temp_c + 273.15{_D}) - 273.15{_D}) + 32.0{_D})
          - ((0.55{_D} - 0.0055{_D} * rh) * (1.8{_D} * ((temp_c + 273.15{_D}) - 273.15{_D}) - 26.0{_D})) AS thi_from_k
      FROM (SELECT *, CASE WHEN stationtype <> 'error' THEN humidity END AS rh FROM ({READINGS_SQL}) r0) r""",
    "align_schema": aligned_sql(),
    "union_evolved": f"""SELECT PASSKEY, "timestamp", seq, tempf, humidity,
        CASE WHEN "timestamp" < TIMESTAMP '2024-01-15 00:00:00' THEN NULL ELSE thi END AS thi
      FROM ({READINGS_SQL}) r""",
    "scan_station": aligned_sql(f"""SELECT * FROM (
        SELECT * FROM ({READINGS_SQL}) r UNION ALL
        SELECT * REPLACE (seq + 1000000000000 AS seq, tempf + 1.0 AS tempf) FROM ({READINGS_SQL}) r WHERE seq % 50 = 10) u
      QUALIFY row_number() OVER (PARTITION BY PASSKEY, "timestamp" ORDER BY seq DESC) = 1""",
                                where="WHERE PASSKEY = 'st_7'"),
    "latest_reading": f"""{_readings_cols()}
      QUALIFY row_number() OVER (PARTITION BY PASSKEY ORDER BY "timestamp" DESC, seq DESC) = 1""",
    "range_scan": f"""{_readings_cols()}
      WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""",
    "range_scan_1h": f"""SELECT * FROM ({rollup_sql("1h")}) q
      WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 00:30:00' AND TIMESTAMP '2024-01-12 12:15:00'""",
    "upsert_latest_wins": f"""SELECT CAST(CAST("timestamp" AS DATE) AS TIMESTAMP) AS "timestamp",
        {', '.join(READING_COLUMNS[1:])}
      FROM ({READINGS_SQL}) r
      QUALIFY row_number() OVER (PARTITION BY PASSKEY, CAST("timestamp" AS DATE) ORDER BY seq DESC) = 1""",
    "feed_latest_bucket": f"""WITH r AS ({READINGS_SQL})
      SELECT 'raw' AS data_type, PASSKEY, "timestamp", CAST(NULL AS BIGINT) AS sample_count, {_FEED_RAW} FROM r
        QUALIFY row_number() OVER (PARTITION BY PASSKEY ORDER BY "timestamp" DESC, seq DESC) = 1
      UNION ALL {_feed_part("1m")}
      UNION ALL {_feed_part("1h")}
      UNION ALL {_feed_part("1d")}""",
    "station_resolve": f"""SELECT r.event_id, f.station_id FROM ({REP}) r JOIN ({FIRST_ST}) f
        ON r.user_id = f.user_id WHERE r.PASSKEY IS NOT NULL""",
    "station_unknown": f"""SELECT r.event_id, r.PASSKEY FROM ({REP}) r
        WHERE r.PASSKEY IS NOT NULL AND r.user_id NOT IN (SELECT user_id FROM ({ST}) s)""",
    "scope_migrate": MIGRATED,
    "scope_migrate_strict": f"""SELECT ordinal, title, weatherstations FROM ({MIGRATED}) m WHERE n_unresolved = 0""",
    # Records with the wildcard see the same rows: the first of them has them, the others name it.
    "scope_stations": f"""WITH res AS ({SCOPE_RES}), acc AS ({ACCEPTED}),
      wild AS (SELECT user_id, min(user_id) OVER () AS first FROM (SELECT DISTINCT user_id FROM res WHERE v = '*') w0)
      SELECT DISTINCT res.user_id AS ordinal, res.user_id AS same_as, acc.station_id AS PASSKEY, acc.event_id AS seq
      FROM acc JOIN res ON res.v = acc.station_id WHERE res.user_id NOT IN (SELECT user_id FROM wild)
      UNION ALL SELECT w.user_id, w.first, acc.station_id, acc.event_id FROM wild w JOIN acc ON w.user_id = w.first
      UNION ALL SELECT user_id, first, NULL, NULL FROM wild WHERE user_id <> first""",
    "scope_visible": f"""WITH res AS ({SCOPE_RES}), acc AS ({ACCEPTED}),
      per_station AS (SELECT station_id, count(*) AS n FROM acc GROUP BY station_id),
      wild AS (SELECT DISTINCT user_id FROM res WHERE v = '*'),
      seen AS (SELECT l.user_id, sum(p.n) AS n FROM (SELECT DISTINCT user_id, v FROM res) l
               JOIN per_station p ON l.v = p.station_id GROUP BY l.user_id)
      SELECT u.user_id AS ordinal, 'key ' || CAST(u.user_id % 5 AS VARCHAR) AS title,
        CAST(CASE WHEN w.user_id IS NOT NULL THEN (SELECT count(*) FROM acc) ELSE coalesce(s.n, 0) END AS BIGINT)
          AS visible_rows
      FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN wild w USING (user_id) LEFT JOIN seen s USING (user_id)""",
    "scope_endpoints": f"""SELECT DISTINCT e.user_id AS ordinal, n.endpoint FROM events e JOIN (VALUES
        ('view', '/data/{{station_id}}/{{data_type}}/current'), ('click', '/data/{{station_id}}/{{data_type}}/range'),
        ('signup', '/ws/{{station_id}}/{{data_type}}'), ('error', '/storage/status')) n(kind, endpoint)
        ON e.event_type = n.kind OR e.event_type = 'purchase'""",
    "scope_endpoint_flags": """SELECT user_id AS ordinal,
        bool_or(event_type IN ('view', 'purchase')) AS allowed_current,
        bool_or(event_type IN ('click', 'purchase')) AS allowed_range,
        bool_or(event_type IN ('signup', 'purchase')) AS allowed_ws,
        bool_or(event_type IN ('error', 'purchase')) AS allowed_storage
      FROM events GROUP BY user_id""",
    "usage_status": f"""WITH s AS (SELECT coalesce(PASSKEY, '') AS station, count(*) AS reports,
          CAST(sum(strlen(body)) AS BIGINT) AS size_bytes FROM ({REP}) r GROUP BY 1),
      b AS (SELECT * FROM s UNION ALL SELECT '*', CAST(coalesce(sum(reports), 0) AS BIGINT),
                   CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM s)
      SELECT *, CASE WHEN size_bytes / 1073741824.0{_D} >= 0.00003 THEN 'error'
                     WHEN size_bytes / 1073741824.0{_D} >= 0.00001 THEN 'warning' ELSE 'ok' END AS status FROM b""",
    "allowlist_insert": f"""WITH st AS ({ST}),
      newe AS (SELECT 1000000000000 + event_id AS ordinal,
                      'new station ' || CAST(user_id AS VARCHAR) AS title,
                      {STATION_HASH.format(eid='event_id', uid='user_id')} AS salted_station_hash,
                      sha256('fixture pepper:PK' || CAST(user_id AS VARCHAR)) AS passkey_digest
               FROM events WHERE event_type = 'purchase')
      SELECT ordinal, title, salted_station_hash, passkey_digest FROM st
      UNION ALL
      SELECT ordinal, title, salted_station_hash, passkey_digest FROM newe
        WHERE passkey_digest NOT IN (SELECT passkey_digest FROM st)
        QUALIFY row_number() OVER (PARTITION BY passkey_digest ORDER BY ordinal) = 1""",
    "split_csv": """SELECT event_id, array_to_string(l, '|') AS items, CAST(len(l) AS BIGINT) AS n_items FROM (
        SELECT event_id, list_filter(list_transform(string_split(
            event_type || ', ,' || ' k' || json_extract_string(props, '$.k') || ',, ' || CAST(user_id AS VARCHAR), ','),
            lambda x: trim(x)), lambda x: x <> '') AS l
        FROM events) t""",
}

ORACLE |= {
    "rollup_coded": f"""SELECT q.*, c.station_code FROM ({rollup_sql("1d", WIDE_SQL, fields=AGGREGATABLE_FIELDS)}) q
JOIN (SELECT PASSKEY, CAST(row_number() OVER (ORDER BY late, PASSKEY) - 1 AS INTEGER) AS station_code
      FROM (SELECT PASSKEY, min("timestamp") >= TIMESTAMP '2024-01-15 00:00:00' AS late FROM ({WIDE_SQL}) w
            GROUP BY PASSKEY) s) c ON q.PASSKEY = c.PASSKEY""",
    "rollup_merged": rollup_sql("1d", CORRECTED_SQL),
    "union_supertypes": f"""SELECT seq, CASE WHEN old THEN seq::VARCHAR ELSE 'n' || seq::VARCHAR END AS code,
        CASE WHEN old THEN date_trunc('day', "timestamp")::TIMESTAMP ELSE "timestamp" END AS day, humidity,
        CASE WHEN old THEN NULL ELSE stationtype END AS stationtype, humidity AS level,
        CASE WHEN old THEN 2 ELSE 1 END::BIGINT AS n_levels
      FROM (SELECT *, "timestamp" < TIMESTAMP '2024-01-15 00:00:00' AS old FROM ({READINGS_SQL}) r0) r""",
    "strict_cast": aligned_sql(),
    "report_log": f"SELECT event_id, PASSKEY, tempf_text AS tempf, model, freq, uv_text AS uv FROM ({REP}) r",
    "registry_stations": f"""SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, title, salted_station_hash, passkey_digest
      FROM ({ST}) s""",
    "registry_scopes": f"""WITH s AS (SELECT user_id, station, min(event_id) AS first FROM (
          SELECT user_id, event_id,
                 CASE WHEN event_type = 'purchase' AND value > 300.0 THEN '*'
                      WHEN user_id % 4 = 1 THEN 'PK' || CAST(user_id AS VARCHAR) ELSE 'PK' || k END AS station
          FROM ({EV}) e WHERE user_id % 7 <> 0) g GROUP BY ALL),
      l AS (SELECT user_id, string_agg(station, ',' ORDER BY first) AS weatherstations FROM s GROUP BY 1),
      u AS (SELECT user_id, string_agg(DISTINCT n.endpoint, ',' ORDER BY n.endpoint) AS endpoints FROM events e JOIN (VALUES
        ('view', '/data/{{station_id}}/{{data_type}}/current'), ('click', '/data/{{station_id}}/{{data_type}}/range'),
        ('signup', '/ws/{{station_id}}/{{data_type}}'), ('error', '/storage/status'), ('purchase', '*')) n(kind, endpoint)
        ON e.event_type = n.kind GROUP BY 1)
      SELECT row_number() OVER (ORDER BY user_id) - 1 AS ordinal, 'key ' || CAST(user_id % 5 AS VARCHAR) AS title, endpoints,
             coalesce(weatherstations, '') AS weatherstations FROM u LEFT JOIN l USING (user_id)""",
    # Derived fields keep their values: only the source field is corrected.
    "stored_raw": aligned_sql(CORRECTED_SQL),
    "stored_rollups": rollup_sql("1h", CORRECTED_SQL),
    "csv_export": aligned_sql(where="""WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"""),
    # Batches by the parity of the arrival number; a channel's last message is of the last batch with an accepted report.
    "stream_ingest": f"""WITH stored AS ({STORED}), acc AS (
        SELECT station_id AS PASSKEY, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t, event_id, event_id % 2 AS batch,
               TRY_CAST(tempf_text AS DOUBLE) AS tempf FROM ({ACCEPTED}) a),
      newest AS (SELECT PASSKEY, max(batch) AS batch, max(t) AS last FROM acc GROUP BY PASSKEY),
      days AS ({rollup_sql("1d", "SELECT * FROM stored", fields=["tempf", "thi"])}),
      feed AS (
        SELECT 'raw' AS data_type, PASSKEY, t AS "timestamp", batch, NULL::BIGINT AS sample_count, tempf, NULL::DOUBLE AS tempf_max
        FROM acc QUALIFY row_number() OVER (PARTITION BY PASSKEY ORDER BY batch DESC, t DESC, event_id DESC) = 1
        UNION ALL {_stream_channel("1m")} UNION ALL {_stream_channel("1h")} UNION ALL {_stream_channel("1d")})
      SELECT 'stored' AS kind, seq AS event_id, PASSKEY, "timestamp", tempf, NULL::VARCHAR AS reject_reason, NULL::BIGINT AS batch,
             NULL::BIGINT AS sample_count, {", ".join(f"NULL::DOUBLE AS {f}_{st}" for f in ("tempf", "thi") for st in ROLLUP_STATS)}
        FROM stored
      UNION ALL BY NAME SELECT 'refused' AS kind, event_id, reject_reason FROM ({REJECTED}) r
      UNION ALL BY NAME SELECT '1d' AS kind, * FROM days
      UNION ALL BY NAME SELECT 'feed ' || data_type AS kind, * EXCLUDE data_type FROM feed""",
}
