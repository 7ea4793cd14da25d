"""The corpus queries that have SQL, against DuckDB on sf0.01."""

import duckdb
import pytest
from llm_data import SF001

from stationlake.llm.oracle import ORACLE
from stationlake.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = REGISTRY[name](spark, SF001)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(
        repr(tuple(r[i] for i in at)) for r in rel.fetchall())
