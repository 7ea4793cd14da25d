"""Training-data pipeline: quality rules, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and is written as Parquet and read again.  All but the last return the
columns of ``documents``; the last returns the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stationlake.llm import line_dedup, packing, quality_rules, simhash
from stationlake.llm._base import staging, table
from stationlake.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document."""
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    return simhash.keep_representatives(docs, shingle=3, max_bits=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining text as sequences in buckets and batches."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage),
          ("simhash_near_dedup", near_dedup_stage), ("packing", packing_stage)]

#: The learned rules and the near-duplicate components have no SQL form; the
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with staging(spark):  # what the stage's operator staged goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
