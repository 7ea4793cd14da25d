"""Rows of the sf0.01 tables for the brute-force versions."""

import pytest

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="session")
def pages(spark):
    rows = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    return [(r.page_id, r.url, r.html) for r in rows]
