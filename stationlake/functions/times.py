"""Time parsing and bucketing.

Storage convention: ``timestamp`` is TIMESTAMP_NTZ holding the UTC wall
clock.  Nothing here depends on ``spark.sql.session.timeZone``:

* strings are parsed with an explicit zone (`` Z`` appended when absent),
  giving an instant, which is turned into UTC wall-clock NTZ by adding its
  epoch micros to the NTZ epoch (``timestampadd`` on NTZ is zone-free,
  whereas ``timestampdiff`` / ``date_trunc`` on NTZ are not);
* NTZ buckets are rebuilt from the value's own fields (``make_timestamp_ntz``,
  ``to_date``), which never consult the session zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationlake.schema import INTERVALS

def ntz_lit(value: datetime | str) -> Column:
    """TIMESTAMP_NTZ literal from a naive datetime (or its text).

    Built from text: ``F.lit`` of a Python datetime makes an instant in the
    session zone first, which a later cast would shift.
    """
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def _epoch_ntz() -> Column:
    return ntz_lit("1970-01-01 00:00:00")


# --- Fixed values: accepted text shapes --------------------------------------
# Station `dateutc`: "YYYY-MM-DD HH:MM:SS", always UTC; 4-digit year,
# one- or two-digit other parts, whitespace run between date and time.
DATEUTC_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
DATEUTC_PATTERN = "yyyy-M-d H:m:s X"
# ISO-8601 range bounds: date, optional time, optional zone (Z or +HH:MM).
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)?$"
)
ISO_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
ISO_HAS_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?)$"
# ------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant_to_utc_ntz(c: Column | str) -> Column:
    """TIMESTAMP (an instant) -> TIMESTAMP_NTZ of its UTC wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(c)), _epoch_ntz())


def parse_dateutc(c: Column | str) -> Column:
    """Strict station time text -> UTC wall-clock NTZ; null when invalid.

    Accepts unpadded parts ("2024-3-9 7:5:0"); refuses a 'T' separator,
    trailing text, two-digit years and impossible dates (Feb 30).
    """
    s = _col(c)
    normalized = F.regexp_replace(F.trim(s), r"\s+", " ")
    parsed = F.try_to_timestamp(F.concat(normalized, F.lit(" Z")), F.lit(DATEUTC_PATTERN))
    return F.when(s.rlike(DATEUTC_SHAPE), instant_to_utc_ntz(parsed))


def parse_iso(c: Column | str) -> Column:
    """ISO-8601 text (trailing ``Z``, ``+HH:MM`` or naive) -> UTC NTZ.

    Naive text means UTC (F8); a bare date means midnight.  Malformed text
    gives null.
    """
    s = F.trim(_col(c))
    dated = F.when(s.rlike(ISO_DATE_ONLY), F.concat(s, F.lit(" 00:00:00"))).otherwise(s)
    zoned = F.when(dated.rlike(r"[T ]\d{2}.*" + ISO_HAS_ZONE), dated).otherwise(
        F.concat(dated, F.lit("Z")))
    parsed = F.try_to_timestamp(zoned)
    return F.when(s.rlike(ISO_SHAPE), instant_to_utc_ntz(parsed))


def ensure_utc(value: datetime | str) -> datetime:
    """F8 for driver-side bounds: aware -> converted to UTC, naive -> UTC.

    Returns a naive datetime of the UTC wall clock, matching the NTZ store.
    Strings follow F9 (``Z`` accepted).
    """
    if isinstance(value, str):
        text = value.strip()
        if text.endswith("Z"):
            text = text[:-1] + "+00:00"
        value = datetime.fromisoformat(text)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def bucket(ts: Column | str, interval: str) -> Column:
    """start of the minute / hour / day bucket (``1m``/``1h``/``1d``)
    of a UTC wall-clock TIMESTAMP_NTZ.

    Built from the NTZ's own date and time fields, which never consult the
    session zone (``date_trunc`` on NTZ would: it returns an instant and
    shifts times on DST days).  Any number of buckets may share a select.
    """
    known_interval(interval)
    t = _col(ts)
    if interval == "1d":
        return F.to_date(t).cast("timestamp_ntz")
    minute = F.minute(t) if interval == "1m" else F.lit(0)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), minute, F.lit(0))


def known_interval(interval: str) -> str:
    """The granularity itself, or an error that names the known ones."""
    if interval not in INTERVALS:
        raise ValueError(f"no granularity is called {interval!r}; there are {', '.join(INTERVALS)}")
    return interval
