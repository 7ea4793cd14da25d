"""Every registered query against its DuckDB SQL on the sf0.001 tables, and
the driver contract (entry, names, columns)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001
from stationlake.plans.oracle import ORACLE
from stationlake.plans.queries import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_contract(spark):
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and set(ORACLE) == set(REGISTRY)
    assert len(qs) >= 27
    df = entry.entry(spark)
    assert df.count() > 0 and "sample_count" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
