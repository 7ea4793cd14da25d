"""Report validation, rejects, key resolution and alignment.

Cases follow the service's own ingest checks: missing key, missing time,
a non-number, a repeated timestamp (later value kept), an unknown key.
"""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.operators import ingest
from stationlake.operators.stations import passkey_digest
from stationlake.operators.upsert import latest_wins
from stationlake.schema import raw_schema

KEY = "TESTKEY0001"
PEPPER = "test pepper"
OTHER = "TESTKEY0002"
STATION = "pbkdf2_sha256$600000$aa$bb"


def allow_list(spark, entries):
    df = spark.createDataFrame(entries, "ordinal long, title string, salted_station_hash string, key string")
    return df.withColumn("passkey_digest", passkey_digest(F.col("key"), PEPPER)).drop("key")


def report(**kv):
    return "&".join(f"{k}={v}" for k, v in kv.items())


BASE = dict(PASSKEY=KEY, dateutc="2026-07-17+07%3A00%3A27", tempf="91.8", humidity="52", winddir="248")


def run(spark, bodies, stations=None):
    reps = spark.createDataFrame([(i, i, b) for i, b in enumerate(bodies)], "id long, received long, body string")
    stations = stations if stations is not None else allow_list(spark, [(1, "home", STATION, KEY)])
    acc, rej = ingest.ingest(reps, stations, PEPPER)
    return acc, {r["id"]: r["reject_reason"] for r in rej.collect()}


def test_valid_report_stored_under_station_id(spark):
    acc, rej = run(spark, [report(**BASE, model="MODEL_A1", freq="433M")])
    assert rej == {}
    rows = acc.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["PASSKEY"] == STATION                      # the raw key is never stored
    assert r["timestamp"] == datetime(2026, 7, 17, 7, 0, 27)
    assert r["temp_c"] == pytest.approx(33.2222, abs=1e-4)
    assert r["thi"] == pytest.approx(82.8768, abs=1e-4)
    assert r["model"] == "MODEL_A1" and r["freq"] == "433M"
    assert acc.columns == raw_schema().fieldNames() + ["seq"]


def test_rejects_in_service_order(spark):
    no_key = {k: v for k, v in BASE.items() if k != "PASSKEY"}
    no_time = {k: v for k, v in BASE.items() if k != "dateutc"}
    bodies = [
        report(**no_key),
        report(**no_time),
        report(**{**BASE, "tempf": "not-a-number"}),
        report(**{**BASE, "PASSKEY": OTHER}),
        report(**{**BASE, "tempf": "nan"}),
        report(**{**BASE, "tempf": "1.5d"}),
        report(**{**BASE, "dateutc": "2026-07-17T07%3A00%3A27"}),
        report(**{**BASE, "foo": "1"}),
        report(**{**BASE, "PASSKEY": ""}),
        report(**{**BASE, "PASSKEY": OTHER, "tempf": "x"}),  # station check comes first
    ]
    acc, rej = run(spark, bodies)
    assert acc.count() == 0
    assert rej == {
        0: "missing PASSKEY", 1: "missing dateutc", 2: "invalid number: tempf",
        3: "unknown station", 4: "invalid number: tempf", 5: "invalid number: tempf",
        6: "invalid dateutc", 7: "unknown field: foo", 8: "missing PASSKEY", 9: "unknown station",
    }


def test_same_time_twice_keeps_later_value(spark):
    acc, _ = run(spark, [report(**{**BASE, "tempf": "70.0"}), report(**{**BASE, "tempf": "80.0"})])
    rows = latest_wins(acc, seq="seq").collect()
    assert len(rows) == 1 and rows[0]["tempf"] == 80.0


def test_first_allow_list_entry_wins(spark):
    stations = allow_list(spark, [(2, "second", "pbkdf2_sha256$second", KEY),
                                  (1, "first", "pbkdf2_sha256$first", KEY)])
    acc, _ = run(spark, [report(**BASE)], stations)
    assert [r["PASSKEY"] for r in acc.collect()] == ["pbkdf2_sha256$first"]


def test_number_text_forms(spark):
    bodies = [report(**{**BASE, "tempf": v}) for v in ("+91.8+", "-3", ".5", "1e2", "0x10", "inf", "", "1e999", "-1e999")]
    acc, rej = run(spark, bodies)
    assert sorted(r["tempf"] for r in acc.collect()) == [-3.0, 0.5, 91.8, 100.0]
    assert sorted(rej) == [4, 5, 6, 7, 8]


def test_repeated_form_key_last_value(spark):
    acc, _ = run(spark, [report(**BASE) + "&tempf=95.5"])
    assert acc.first()["tempf"] == 95.5


def test_align_schema(spark):
    df = spark.createDataFrame([("1", 2)], "a string, b int")
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.StringType()),
                           T.StructField("c", T.DoubleType())])
    out = ingest.align(df, schema)
    assert out.columns == ["b", "a", "c"]
    assert out.schema["b"].dataType == T.DoubleType()
    assert out.first()["c"] is None
    with pytest.raises(ValueError, match="no column for zz"):
        ingest.align(df.withColumn("zz", F.lit(1)), schema)
    assert ingest.align(df.withColumn("zz", F.lit(1)), schema, on_unknown="drop").columns == ["b", "a", "c"]
    bad = spark.createDataFrame([("x",)], "b string")
    assert ingest.align(bad, schema, strict=False).first()["b"] is None
    with pytest.raises(Exception):
        ingest.align(bad, schema).collect()                         # an uncastable value fails the job
