"""Plan properties the scale design relies on (checked without running)."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF0001
from stationlake.plans.queries import REGISTRY

# A wildcard record is one row that every reading is paired with.
ONE_ROW_BROADCAST = {"scope_stations"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# It runs the whole stream while it is built; the tables that it reads then say nothing about the batches' plans.
STREAM = {"stream_ingest"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAM))
def test_no_python_no_cartesian(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF0001))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert "CartesianProduct" not in plan
    if name not in ONE_ROW_BROADCAST:
        assert "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["rollup_1m", "rollup_1h", "rollup_1d", "rollup_wide"])
def test_rollup_scans_only_needed_columns(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF0001))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas == {"struct<ts:timestamp_ntz,user_id:bigint,value:double,props:string>"}


@pytest.mark.parametrize("name,scans", [("scope_visible", 4), ("feed_latest_bucket", 2), ("upsert_latest_wins", 1),
                                        ("latest_reading", 1), ("ingest_accepted", 2), ("rollup_1h", 2)])
def test_scans_planned(spark, name, scans):
    """Without relying on the reuse of equal exchanges."""
    plan = plan_of(entry.queries()[name](spark, SF0001))
    assert len(re.findall("FileScan", plan)) <= scans


@pytest.mark.parametrize("name", ["upsert_latest_wins", "latest_reading", "scan_station"])
def test_winners_take_one_shuffle_and_a_limit_before_it(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF0001))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan
    partial = plan.index("WindowGroupLimit", plan.index("Exchange"))  # below the exchange
    assert "Partial" in plan[partial:partial + 300]


def test_store_range_read_is_pushed_down(spark, scratch):
    from datetime import datetime

    from stationlake.operators.ingest import align
    from stationlake.schema import raw_schema
    from stationlake.sinks import tables
    from stationlake.sources import store

    rows = spark.createDataFrame([("a", datetime(2026, 7, 17, 7), 70.0, 1)],
                                 "PASSKEY string, timestamp timestamp_ntz, tempf double, seq long")
    tables.upsert(spark, align(rows, raw_schema(), keep=["seq"]), scratch)
    df = store.read_range(spark, scratch, "raw", "2026-07-17", "2026-07-18", station="a").select("tempf")
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(date" in plan
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(PASSKEY,a\)", plan)
    assert "GreaterThanOrEqual(timestamp" in plan
