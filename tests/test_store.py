"""Store tables: upsert, scans, latest, range, CSV, usage."""

import glob
import os
from datetime import datetime, timedelta

import pytest

from stationlake.operators.ingest import align
from stationlake.operators.rollup import rollup
from stationlake.operators.upsert import union_evolved
from stationlake.operators.usage import usage_status
from stationlake.schema import raw_schema, rollup_schema
from stationlake.sinks import tables
from stationlake.sources import store


def raw_rows(spark, rows):
    """rows: (station, timestamp, tempf, seq)"""
    df = spark.createDataFrame(rows, "PASSKEY string, timestamp timestamp_ntz, tempf double, seq long")
    return align(df, raw_schema(), keep=["seq"])


T0 = datetime(2026, 7, 17, 7, 0, 0)


def test_absent_tables_are_empty_with_schema(spark, scratch):
    df = store.read_all(spark, scratch, "raw")
    assert df.count() == 0 and df.columns == raw_schema().fieldNames()
    assert store.read_all(spark, scratch, "1h").columns == rollup_schema().fieldNames()
    with pytest.raises(ValueError):
        store.read_all(spark, scratch, "2h")


def test_upsert_latest_wins_and_touches_only_its_dates(spark, scratch):
    tables.upsert(spark, raw_rows(spark, [("a", T0, 70.0, 1), ("a", T0 + timedelta(days=1), 60.0, 2),
                                         ("b", T0, 50.0, 3)]), scratch)
    tables.upsert(spark, raw_rows(spark, [("a", T0, 80.0, 4)]), scratch)      # same key, later arrival
    got = {(r["PASSKEY"], r["timestamp"]): r["tempf"] for r in store.read_all(spark, scratch).collect()}
    assert got == {("a", T0): 80.0, ("a", T0 + timedelta(days=1)): 60.0, ("b", T0): 50.0}
    # Replaying the same batch changes nothing.
    tables.upsert(spark, raw_rows(spark, [("a", T0, 80.0, 4)]), scratch)
    assert store.read_all(spark, scratch).count() == 3
    assert store.read_all(spark, scratch, station="a").count() == 2
    dates = sorted(os.path.basename(p) for p in glob.glob(f"{scratch}/raw/date=*"))
    assert dates == ["date=2026-07-17", "date=2026-07-18"]


def test_latest_and_range(spark, scratch):
    rows = [("a", T0 + timedelta(seconds=30 * i), 70.0 + i, i) for i in range(10)]
    rows += [("b", T0 - timedelta(days=2), 1.0, 100)]
    tables.upsert(spark, raw_rows(spark, rows), scratch)
    latest = {r["PASSKEY"]: r for r in store.read_latest(spark, scratch, "raw").collect()}
    assert latest["a"]["tempf"] == 79.0 and latest["b"]["tempf"] == 1.0
    assert store.read_latest(spark, scratch, "raw", station="zz").count() == 0
    r = store.read_range(spark, scratch, "raw", "2026-07-17T07:01:00Z", "2026-07-17 07:02:00", station="a")
    assert [x["tempf"] for x in r.collect()] == [72.0, 73.0, 74.0]          # both ends included, sorted
    narrower = store.read_range(spark, scratch, "raw", "2026-07-17T07:01:30+00:00", "2026-07-17 07:02:00")
    assert narrower.count() <= r.count()
    assert store.read_range(spark, scratch, "raw", "2000-01-01", "2000-01-02").count() == 0
    with pytest.raises(ValueError):
        store.read_range(spark, scratch, "raw", "2026-07-18", "2026-07-17")
    with pytest.raises(ValueError):
        store.read_range(spark, scratch, "raw", "not-a-date", "2026-07-17")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters" in plan


def test_rollup_table_and_csv(spark, scratch):
    rows = [("a", T0 + timedelta(seconds=30 * i), 70.0 + i, i) for i in range(4)]
    raw = raw_rows(spark, rows)
    tables.write_table(align(rollup(raw.drop("seq"), "1m"), rollup_schema()), scratch, "1m")
    one_m = store.read_all(spark, scratch, "1m")
    assert one_m.count() == 2 and one_m.count() < len(rows)
    assert store.read_latest(spark, scratch, "1m").first()["tempf_avg"] == 72.5
    out = f"{scratch}/csv"
    tables.export_csv(store.read_range(spark, scratch, "raw", T0, T0 + timedelta(hours=1)), out)
    before = "".join(open(p).read() for p in glob.glob(f"{out}/*.csv"))
    assert before.startswith("timestamp,PASSKEY,") and before.count("\n") == 1   # no rows yet: header
    tables.upsert(spark, raw, scratch)
    tables.export_csv(store.read_range(spark, scratch, "raw", T0, T0 + timedelta(hours=1)), out)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out}/*.csv")))
    assert text.startswith("timestamp,PASSKEY,") and text.count("\n") == 5
    empty = f"{scratch}/csv_empty"
    tables.export_csv(store.read_range(spark, scratch, "raw", "2000-01-01", "2000-01-02"), empty)
    header = "".join(open(p).read() for p in glob.glob(f"{empty}/*.csv"))
    assert header.strip().startswith("timestamp,PASSKEY,") and header.count("\n") == 1


def test_recompute_rollups(spark, scratch):
    rows = [("a", T0 + timedelta(minutes=20 * i), 70.0 + i, i) for i in range(8)]
    tables.upsert(spark, raw_rows(spark, rows), scratch)
    tables.recompute_rollups(spark, scratch)
    assert store.read_all(spark, scratch, "1m").count() == 8
    assert store.read_all(spark, scratch, "1h").count() == 3
    day = store.read_all(spark, scratch, "1d").first()
    assert day["sample_count"] == 8 and day["tempf_avg"] == 73.5
    plan = store.read_all(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                       # stored rows are already resolved


def test_union_evolved(spark):
    old = spark.createDataFrame([("a", T0, 1)], "PASSKEY string, timestamp timestamp_ntz, humidity int")
    new = spark.createDataFrame([("a", T0, 2.5, 80.0)],
                                "PASSKEY string, timestamp timestamp_ntz, humidity double, thi double")
    u = union_evolved(old, new)
    assert dict(u.dtypes)["humidity"] == "double"
    assert sorted((r["humidity"], r["thi"]) for r in u.collect()) == [(1.0, None), (2.5, 80.0)]


@pytest.mark.parametrize("mib,status", [(0, "ok"), (2, "warning"), (4, "error")])
def test_usage_thresholds(spark, scratch, mib, status):
    os.makedirs(f"{scratch}/raw", exist_ok=True)
    if mib:
        with open(f"{scratch}/raw/blob.bin", "wb") as fh:
            fh.write(b"\0" * (mib * 1024 * 1024))
    else:
        open(f"{scratch}/raw/empty.bin", "wb").close()
    total = [r for r in usage_status(spark, scratch, 0.001, 0.003).collect() if r["table"] == "*"][0]
    assert total["size_bytes"] == mib * 1024 * 1024
    assert total["status"] == status
    with pytest.raises(ValueError):
        usage_status(spark, scratch, 0.003, 0.001)


def test_usage_of_nested_folders_and_rows(spark, scratch):
    """A folder whose path repeats inside itself counts under its own table."""
    from pyspark.sql import functions as F

    from stationlake.operators.usage import report_usage

    deep = f"{scratch}/raw{scratch}/x"
    os.makedirs(deep)
    with open(f"{deep}/blob.bin", "wb") as fh:
        fh.write(b"12345")
    assert {r["table"]: r["size_bytes"] for r in usage_status(spark, scratch).collect()} == {"raw": 5, "*": 5}
    df = spark.createDataFrame([("a", "12"), ("a", "é"), (None, "1"), ("b", None)], "s string, body string")
    got = {r["station"]: (r["reports"], r["size_bytes"], r["status"])
           for r in report_usage(df, F.col("s"), F.col("body"), 2 / 1024 ** 3, 4 / 1024 ** 3).collect()}
    assert got == {"a": (2, 4, "error"), "": (1, 1, "ok"), "b": (1, 0, "ok"), "*": (4, 5, "error")}


def test_range_by_table_name(spark):
    raw = raw_rows(spark, [("a", T0 + timedelta(minutes=20 * i), 70.0 + i, i) for i in range(8)])
    hours = store.range_of("1h", raw, "2026-07-17T07:10:00Z", "2026-07-17T08:59:00Z")
    assert [r["timestamp"] for r in hours.collect()] == [T0 + timedelta(hours=1)]
    assert store.range_of("raw", raw, T0, T0 + timedelta(minutes=20)).count() == 2
    with pytest.raises(ValueError, match="no table is called"):
        store.range_of("2h", raw, T0, T0)
