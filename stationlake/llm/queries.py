"""The registered queries of the corpus operators.

Each `opN_<name>` applies its operator to the whole table with production
parameters and derives the digest columns from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import (bpe, conversation_trie, exact_dedup, html_diff, license_rules, line_dedup, mixing, packing,
                             quality_rules, sharding, simhash, vector_codes, warc)
from stationlake.llm._base import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "rule", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = coder.encode(table(spark, sf_dir, "documents"), "text", "ids", keep=["doc_id"], decoded_col="decoded")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract_text(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages"), min_bytes=0, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = conversation_trie.turn_strings(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie_nodes(conversation_trie.graft(strings, every=20, shared=4))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.train(table(spark, sf_dir, "embeddings"), n_parts=8, k=16, rounds=6, scale=4096)
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return vector_codes.with_label_errors(coded).select(
        F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(sha256(",".join(map(str, books.ravel())).encode()).hexdigest()).alias("codebooks_sha256"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_exact_dedup, op4_bpe, op5_sharding, op6_html_text,
                            op7_warc, op8_packing, op9_license_scan, op10_simhash, op11_mixing, op12_conversation_trie,
                            op13_vector_codes)}
