"""Scalar functions: units (F1-F7), times (P3, F8-F10), text."""

from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl

import pytest
from pyspark.sql import functions as F

from stationlake.functions import units
from stationlake.functions.text import decode_form, decode_form_multi, is_station_id, split_csv, with_form
from stationlake.functions.times import bucket, ensure_utc, parse_dateutc, parse_iso
from stationlake.operators.metric import to_metric


def one(spark, col, value, dtype="double"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


def test_unit_check_values(spark):
    # 91.8 degF and 52 % from a captured report.
    assert one(spark, units.fahrenheit_to_celsius, 91.8) == pytest.approx(33.2222222, abs=1e-6)
    assert one(spark, units.inhg_to_hpa, 29.704) == pytest.approx(1005.89288, abs=1e-4)
    assert one(spark, units.inhg_to_kpa, 0.721) == pytest.approx(2.441586, abs=1e-6)
    assert one(spark, units.mph_to_ms, 10.0) == pytest.approx(4.4704)
    assert one(spark, units.mph_to_kmh, 10.0) == pytest.approx(16.09344)
    assert one(spark, units.inches_to_mm, 1.0) == pytest.approx(25.4)
    df = spark.createDataFrame([(91.8, 52.0)], "t double, rh double")
    r = df.select(units.thi(units.fahrenheit_to_celsius("t"), "rh").alias("c"),
                  units.thi("t", "rh", unit="degF").alias("f"),
                  units.thi(units.fahrenheit_to_celsius("t") + F.lit(273.15), "rh", unit="K").alias("k")).first()
    assert r["c"] == pytest.approx(82.8768, abs=1e-4)
    assert r["f"] == pytest.approx(r["c"])
    assert r["k"] == pytest.approx(r["c"])
    with pytest.raises(ValueError):
        units.thi("t", "rh", unit="rankine")


def test_to_metric_absent_null_and_drop(spark):
    df = spark.createDataFrame([(91.8, 52.0, None), (None, 40.0, 29.7)],
                               "tempf double, humidity double, baromrelin double")
    out = to_metric(df).orderBy(F.col("tempf").asc_nulls_last()).collect()
    assert out[0]["temp_c"] == pytest.approx(33.2222, abs=1e-4)
    assert out[0]["thi"] == pytest.approx(82.8768, abs=1e-4)
    assert out[0]["baromrel_hpa"] is None
    assert out[1]["temp_c"] is None and out[1]["thi"] is None
    assert "windspeed_ms" not in to_metric(df).columns          # absent source adds nothing
    assert "thi" not in to_metric(df.drop("humidity")).columns  # thi needs humidity
    dropped = to_metric(df, keep_original=False)
    assert "tempf" not in dropped.columns and "temp_c" in dropped.columns
    assert "humidity" in dropped.columns


def test_parse_dateutc_strict(spark):
    cases = {
        "2026-07-17 07:00:27": datetime(2026, 7, 17, 7, 0, 27),
        "2026-7-9 7:5:3": datetime(2026, 7, 9, 7, 5, 3),
        "2026-07-17T07:00:27": None,
        "2026-07-17 07:00:27 extra": None,
        "26-07-17 07:00:27": None,
        "2024-02-30 00:00:00": None,
        "2024-01-01 25:00:00": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_dateutc("s").alias("t")).collect()}
    for text, want in cases.items():
        assert got[text] == want, text
    assert got[None] is None


def test_parse_iso_and_ensure_utc(spark):
    cases = {
        "2026-01-01T00:00:00Z": datetime(2026, 1, 1),
        "2026-01-01T00:00:00.000Z": datetime(2026, 1, 1),
        "2026-01-01T07:00:00+07:00": datetime(2026, 1, 1),
        "2026-01-01T00:00:00+00:00": datetime(2026, 1, 1),
        "2026-01-01 00:00:00": datetime(2026, 1, 1),
        "2026-01-01": datetime(2026, 1, 1),
        "2026": None,
        "not-a-date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_iso("s").alias("t")).collect()}
    for text, want in cases.items():
        assert got[text] == want, text
    assert ensure_utc("2026-01-01T07:00:00+07:00") == datetime(2026, 1, 1)
    assert ensure_utc(datetime(2026, 1, 1, 7, tzinfo=timezone(timedelta(hours=7)))) == datetime(2026, 1, 1)
    assert ensure_utc(datetime(2026, 1, 1)) == datetime(2026, 1, 1)


def test_session_zone_does_not_move_times_or_buckets(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 45),)], "ts timestamp_ntz")
        r = df.select(bucket("ts", "1m").alias("m"), bucket("ts", "1h").alias("h"),
                      bucket("ts", "1d").alias("d"),
                      parse_dateutc(F.lit("2024-03-10 02:30:00")).alias("p"),
                      parse_iso(F.lit("2024-03-10T02:30:00")).alias("i")).first()
        assert r["m"] == datetime(2024, 3, 10, 2, 30)
        assert r["h"] == datetime(2024, 3, 10, 2, 0)
        assert r["d"] == datetime(2024, 3, 10)
        assert r["p"] == datetime(2024, 3, 10, 2, 30)
        assert r["i"] == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 0, 0, 0),), (datetime(2024, 1, 1, 23, 59, 59, 999999),)],
                               "ts timestamp_ntz")
    got = sorted(r["d"] for r in df.select(bucket("ts", "1d").alias("d")).collect())
    assert got == [datetime(2024, 1, 1), datetime(2024, 1, 2)]
    with pytest.raises(ValueError):
        bucket("ts", "5m")


BODIES = [
    "PASSKEY=AB12&dateutc=2026-07-17+07%3A00%3A27&tempf=91.8&stationtype=Easy+Weather%2FPro",
    "a=1&a=2&b=&c&&d=x%3Dy=z",
    "k=%ZZ&plus=a+b",
    "",
]


def test_decode_form_matches_python(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "body string")
    for frame in (df.select("body", decode_form("body").alias("form")), with_form(df)):
        rows = {r["body"]: dict(r["form"]) for r in frame.collect()}
        for b in BODIES:
            want = dict(parse_qsl(b, keep_blank_values=True))  # last value wins
            assert rows[b] == want, b
    multi = {r["body"]: dict(r["m"]) for r in df.select("body", decode_form_multi("body").alias("m")).collect()}
    assert multi[BODIES[1]]["a"] == ["1", "2"]


def test_split_csv_and_station_id(spark):
    df = spark.createDataFrame([(" a, ,b ,,c ",), ("",), (None,)], "s string")
    got = [r["x"] for r in df.select(split_csv("s").alias("x")).collect()]
    assert got[0] == ["a", "b", "c"] and got[1] == [] and got[2] is None
    ids = spark.createDataFrame([("*",), ("pbkdf2_sha256$1$ab$cd",), ("RAWKEY",)], "v string")
    assert [r["y"] for r in ids.select(is_station_id("v").alias("y")).collect()] == [True, True, False]


CUT_BODIES = ["a=1&b=2", "", "&", "a", "a=", "=x", "a=1&&b=2", "a=1&a=2", "a%26b=1&c=%3D%26", "a%3Db=1", "x=%E2%82&y=%AC", "a=b=c&d",
              "a+b=c+d&e=%41%4&f=%zz", "a=1&", "&a=1", "p=%&q=%2", "a\nb=c\nd&e=f\n", "a%62=1&ab=2", "a= x &b=é&c=€", None,
              "a%&26=1", "a=%2&6=b", "a=1%3d2&c=1"]


def test_bodies_decoded_as_a_whole_equal_those_by_pairs(spark):
    df = spark.createDataFrame([(b,) for b in CUT_BODIES], "body string")
    for r in with_form(df).withColumn("by_pair", decode_form("body")).collect():
        assert (r["form"] and list(r["form"].items())) == (r["by_pair"] and list(r["by_pair"].items())), r["body"]


def test_plain_bodies_are_decoded_whole_before_they_are_cut(spark):
    plan = with_form(spark.createDataFrame([("a=1",)], "body string"))._jdf.queryExecution().analyzed().toString()
    check = plan.index("RLIKE(body")
    assert check < plan.index("lambdafunction", check)
    assert plan.count("lambdafunction") > 0 and "try_url_decode(regexp_replace(body" in plan
