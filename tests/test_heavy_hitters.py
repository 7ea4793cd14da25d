"""Modes from bounded summaries, against exact counts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationlake.operators.heavy_hitters import TRACKED, open_values, settled, summarised
from stationlake.operators.rollup import modes_bounded, rollup, rollup_all

SHAPE = "PASSKEY string, timestamp timestamp_ntz, tempf double, humidity double, winddir double"
FIELDS = ["tempf", "humidity", "winddir"]
T0 = datetime(2026, 7, 17, 7)


def station_rows(rnd, name, n, kinds):
    """``n`` readings whose three fields are each drawn as ``kinds`` says."""
    draw = {
        "few": lambda i: float(rnd.randint(0, 9)), "unique": lambda i: i + rnd.random(), "null": lambda i: None,
        "heavy": lambda i: 7.0 if rnd.random() < 0.6 else i + 0.5,      # one value above all others
        "close": lambda i: rnd.choice([3.0, 4.0]) if i % 3 else i + 0.5,  # two near each other above many
        "late": lambda i: 500.0 + (i % 7 == 0) if i > n // 2 else i + 0.25, "zero": lambda i: rnd.choice([0.0, -0.0, 1.0]),
    }
    return [(name, T0 + timedelta(seconds=i), *[draw[k](i) for k in kinds]) for i in range(n)]


def many_shapes(seed):
    rnd = random.Random(seed)
    kinds = ["few", "unique", "null", "heavy", "close", "late", "zero"]
    rows = []
    for s in range(14):
        rows += station_rows(rnd, f"st_{s}", rnd.choice([1, 2, 40, 700]), [rnd.choice(kinds) for _ in FIELDS])
    rows += station_rows(rnd, "hot", 5000, ["heavy", "close", "unique"])
    rnd.shuffle(rows)
    return rows


def plain(df):
    return df.columns, sorted(repr([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())


def exact_modes(rows):
    out = {}
    for name in {r[0] for r in rows}:
        for k, f in enumerate(FIELDS):
            seen = Counter(r[2 + k] for r in rows if r[0] == name and r[2 + k] is not None)
            out[name, f] = min(seen, key=lambda v: (-seen[v], v)) if seen else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_what_the_bounds_settle_is_the_mode(spark, seed):
    rows = many_shapes(seed)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    want, n_open, n_settled_with_slack = exact_modes(rows), 0, 0
    for r in settled(df, ["PASSKEY"], FIELDS, tracked=24).collect():
        for i, f in enumerate(FIELDS):
            if i in r["_open"]:
                assert r[f"_mode_{f}"] is None
                n_open += 1
            else:
                assert r[f"_mode_{f}"] == want[r["PASSKEY"], f]
                n_settled_with_slack += r["PASSKEY"] == "hot"
    assert n_open and n_settled_with_slack  # both ways were taken


@pytest.mark.parametrize("seed", [4, 5])
def test_bounded_rollups_equal_exact_ones(spark, seed):
    df = spark.createDataFrame(many_shapes(seed), SHAPE).repartition(5)
    for interval in ("1m", "1h", "1d"):
        assert plain(rollup(df, interval, mode_strategy="bounded")) == plain(rollup(df, interval))
    assert plain(rollup_all(df, mode_strategy="bounded")) == plain(rollup_all(df))


@pytest.mark.parametrize("tracked", [1, 24, 384, 3072])
def test_the_bound_does_not_change_the_modes(spark, tracked):
    rows = many_shapes(6)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    want = exact_modes(rows)
    for r in modes_bounded(df, ["PASSKEY"], FIELDS, tracked).collect():
        for f in FIELDS:
            low = min((x[2 + FIELDS.index(f)] for x in rows if x[0] == r["PASSKEY"] and x[2 + FIELDS.index(f)] is not None),
                      default=None)
            got = r[f"_mode_{f}"]
            assert (low if got is None else got) == want[r["PASSKEY"], f]


def test_only_open_values_are_exploded(spark):
    rows = many_shapes(7)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    judged = settled(df, ["PASSKEY"], FIELDS)
    left = open_values(df, judged, ["PASSKEY"], FIELDS)
    n_values = sum(v is not None for r in rows for v in r[2:])
    want = judged.select("PASSKEY", F.explode("_open").alias("fid")).collect()
    assert {(r["PASSKEY"], r["fid"]) for r in left.select("PASSKEY", "fid").distinct().collect()} == {tuple(r) for r in want}
    assert ("hot", 2) in {tuple(r) for r in want} and 0 < left.count() < n_values / 2


def test_summaries_are_bounded(spark):
    df = spark.range(200_000).select(F.lit("a").alias("PASSKEY"), F.col("id").cast("double").alias("tempf"))
    size = summarised(df, ["PASSKEY"], ["tempf"]).select(F.length("_sum_tempf.sketch")).first()[0]
    assert size <= 16 * TRACKED + 40  # counters of 16 bytes, and the head


def test_edges(spark):
    none = spark.createDataFrame([], SHAPE)
    assert rollup(none, "1h", mode_strategy="bounded").count() == 0
    rows = [("a", T0, 2.0, None, -0.0), ("a", T0, 1.0, None, 0.0), ("a", T0, None, None, -1.0)]
    r = rollup(spark.createDataFrame(rows, SHAPE), "1d", mode_strategy="bounded").first()
    assert (r["tempf_mode"], r["humidity_mode"], r["winddir_mode"]) == (1.0, None, 0.0)
    with pytest.raises(ValueError):
        rollup_all(none, mode_strategy="inline")


def test_a_settled_rollup_is_not_read_again(spark):
    df = spark.createDataFrame([("a", T0, 1.0, 2.0, 3.0)] * 3, SHAPE)
    plan = rollup(df, "1h", mode_strategy="bounded")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("FileScan") == 1 and "Generate" not in plan
