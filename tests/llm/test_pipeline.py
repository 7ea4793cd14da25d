"""The pipeline against brute force, stage by stage and as a whole."""

import brute
from llm_data import SF001, documents  # noqa: F401

import corpus_pipeline
from stationlake.llm import quality_rules


def test_run_equals_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    # Learned verdicts come from the operator (its statistics and accuracy
    # are tested on their own); all that follows is brute force.
    kept = {r.id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    left = [(i, t) for i, t in documents if i in kept]
    left = [(i, t) for i, _, _, t in brute.line_dedup(left)]
    stays = {c for _, _, c in brute.components(left)}
    left = {i: len(brute.words(t)) for i, t in left if i in stays}
    got = {}
    for r in corpus_pipeline.run(spark, SF001).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == left
