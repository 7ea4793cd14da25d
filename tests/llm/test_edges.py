"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, for every operator and stage."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stationlake.llm import (bpe, exact_dedup, html_diff, license_rules, line_dedup, packing, quality_rules, sharding,
                             simhash, warc)

LONG = "word%d " * 30000 % tuple(range(30000))
ROWS = [
    (1, "same line\nown one", "x"), (2, "same line\nown two", None), (2, "same line\nown two", None), (3, None, "x"),
    (4, "", "x"), (None, "same line\nown null id", "x"), (None, None, None), (5, LONG, "x"), (6, LONG + "tail", "x"),
    (7, " Same LINE \n\n same line", "x"), (8, "é ü İ K", "x"), (8, "other text of eight", "x"),
    (9, "\n", "x"), (10, "a\tb", "x"), (11, "a  b", "x"),
]
#: Every helper name that an operator uses inside.
CLASH = ["id", "key", "row", "_row", "n", "run", "keep", "fp", "salt", "root", "shard", "slot", "kept", "n_lines",
         "drops", "size", "_pid", "_pos", "bucket", "batch", "part", "step", "rule", "good", "lines", "host", "norm"]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(r):
    return repr(r)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


PAIRS = [(i, t) for i, t, _ in ROWS]


@pytest.fixture(scope="module")
def labels(spark):
    return with_clashes(spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 0), (5, 1), (99, 0)], "doc_id long, quality long"))


def test_quality(docs, empty, labels):
    out = quality_rules.judge(docs, labels)
    assert got(out, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(
        ((i, *brute.quality_stats(t)) for i, t in PAIRS), key=key)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    stays = quality_rules.keep_good(docs, labels)
    assert stays.columns == docs.columns and stays.count() == sum(not brute.quality_stats(t)[5] for _, t in PAIRS)
    assert quality_rules.keep_good(empty, labels.limit(0)).count() == 0


def test_lines(docs, empty):
    out = line_dedup.drop_lines(docs, min_docs=4, lines_per_shard=8, salts=3)
    want = brute.line_dedup(PAIRS, 4)
    assert got(out, "row.doc_id", "n_lines", "n_dropped", "kept") == sorted(want, key=key)
    assert sum(w[2] for w in want) == 6
    assert line_dedup.drop_lines(empty).count() == 0
    stays = line_dedup.dedup_lines(docs, min_docs=4)
    assert stays.columns == docs.columns
    assert got(stays, "doc_id", "text") == sorted(((i, t) for i, _, _, t in want), key=key)


def test_lines_above_the_byte_count(spark):
    rows = [(k, f"all\n{'most' if k < 299 else 'few'}\nown {k}") for k in range(600)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=300)
    assert got(out, "row.doc_id", "n_lines", "n_dropped", "kept") == sorted(brute.line_dedup(rows, 300), key=key)


def test_exact(docs, empty):
    want = sorted(brute.exact_dedup(PAIRS), key=key)
    for bits in (1, 4):
        for n in (1, 5):
            out = exact_dedup.exact_dedup(docs.repartition(n), fan_in_bits=bits)
            assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_bpe(spark, docs, empty):
    import public_tokenizers

    coder = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = coder.encode(docs, "text", "ids", keep=["doc_id", "text", "id"])
    out = coder.decode(ids, "ids", "back", keep=["doc_id", "text", "id"])
    assert out.columns == ["doc_id", "text", "id", "back"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.back == (r.text or "") and r.id == "clash" for r in rows)
    assert coder.decode(coder.encode(empty, "text", "ids", ["doc_id"]), "ids", "back", ["doc_id"]).count() == 0
    none = ids.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r.back for r in coder.decode(none, "ids", "back", ["doc_id"]).collect()} == {""}


def test_shards(docs, empty):
    for n in (3, 24):
        assert got(sharding.assign_shards(docs, n), "doc_id", "size", "text_crc32", "shard", "slot") == sorted(
            brute.shards(PAIRS, n), key=key)
    assert sharding.assign_shards(empty, 24).count() == 0


def test_shard_files(spark, scratch):
    rows = [(k, "x" * (k % 50)) for k in range(500)] + [(3, "xxx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, f"{scratch}/shards", 4)
    assert got(spark.read.parquet(f"{scratch}/shards"), "doc_id", "text") == sorted(rows, key=key)


def test_shard_files_keep_every_column_and_row(spark, scratch):
    """A column named shard, null ids, and rows of one id, size and checksum."""
    # Two texts of equal length and equal CRC-32.
    a, b = "plumless", "buckeroo"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(None, "x", 7), (None, None, None)] + [(1, t, k) for k, t in enumerate([a, b] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("row", F.lit("clash"))
    sharding.write_shards(docs, f"{scratch}/s", 5)
    back = spark.read.parquet(f"{scratch}/s")
    assert got(back, "doc_id", "text", "shard", "row") == sorted(((*r, "clash") for r in rows), key=key)
    counts = {r["_shard"]: r["count"] for r in back.groupBy("_shard").count().collect()}
    planned = {r.shard: r["count"] for r in sharding.assign_shards(docs, 5).groupBy("shard").count().collect()}
    assert counts == planned
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("_shard", F.lit(1)), f"{scratch}/t", 5)


PAGES = [(1, "http://a/x", "<p>one</p>"), (2, None, None), (2, None, None), (None, "http://a/y z\n", "<p>one</p>"),
         (3, "http://a/x", ""), (4, "not a url", "<p>" + "w " * 50000), (5, "http://A/q?x#y", "<p>&am"), (6, "http://a/x", "<p>one</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_html(pages):
    out = html_diff.extract_text(pages)
    rows = out.collect()
    assert len(rows) == len(PAGES)
    by = {(r.page_id, r.url): r for r in rows}
    assert by[2, None].text == "" and by[2, None].n_chars == 0
    assert by[4, "not a url"].n_chars == 99999
    assert by[5, "http://A/q?x#y"].text == "&am"
    assert html_diff.extract_text(pages.limit(0)).count() == 0


def test_warc(spark, pages):
    rows = warc.convert(pages).collect()
    assert len(rows) == len(PAGES)
    one = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 10)
    assert one == [(False, 1, "response", None), (False, 6, "revisit", 1), (True, None, "revisit", 1)]
    nothing = [r for r in rows if r.payload_bytes == 0]
    assert len(nothing) == 3 and sum(r.record_type == "response" for r in nothing) == 1
    assert all(r.refers_to == 2 for r in nothing if r.record_type == "revisit")
    assert {r.page_id: r.payload for r in rows if r.record_type == "response"}[4] == PAGES[5][2]
    assert all(r.record_type == "response" for r in warc.convert(pages, min_bytes=10**6).collect())
    assert warc.convert(pages.limit(0)).count() == 0


def test_warc_urls_like_version_blocks(spark):
    fake = "1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
    rows = [(k, "filedesc://x.arc", f"<p>{k}</p>") for k in range(6)] + [(9, "filedesc:", fake), (10, "filedesc://a b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(warc.convert(df), "page_id", "payload") == sorted(((i, h) for i, _, h in rows), key=key)


def test_warc_text_ids(spark):
    rows = [(i, "http://a/", "<p>same</p>") for i in ("p9", "b2", "10", "p10", "9")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    assert got(warc.convert(df), "page_id", "record_type", "refers_to") == sorted(
        ((i, "response" if i == "10" else "revisit", None if i == "10" else "10") for i, _, _ in rows), key=key)


def test_warc_payloads_are_recomputed(spark, pages, scratch):
    """A response whose payload is not what its record declares is refused."""
    warc.write_arc(pages, f"{scratch}/arc")
    records = warc.with_revisits(warc.read_arc(spark, f"{scratch}/arc"), warc.read_arc(spark, f"{scratch}/arc", payload=False))
    warc.write_warc(records.withColumn("payload_digest", F.lit("A" * 32)), f"{scratch}/warc")
    with pytest.raises(Exception, match="not the declared one"):
        warc.read_warc(spark, f"{scratch}/warc", payload=False).collect()


def test_staging_scope(spark, docs):
    from stationlake.llm._base import staging

    with staging(spark):
        placed = sharding.assign_shards(docs, 3)
        files = set(placed.inputFiles())
        assert files and placed.count() == len(ROWS)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        placed.count()


def test_packing(docs, empty):
    rows = packing.pack(docs, max_tokens=4096, token_budget=8192).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t in PAIRS:
        want[i] = want.get(i, 0) + len(brute.words(t))
    assert total == want
    assert max((r.n_tokens for r in rows)) == 4096
    assert packing.pack(empty).count() == 0


def test_licenses(docs, empty):
    assert got(license_rules.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(
        ((i, *brute.licence_base(t)) for i, t in PAIRS), key=key)
    assert license_rules.scan(empty).count() == 0


def test_license_places(spark):
    rows = [(1, "cc by cc by"), (2, "CC-BY 4.0 all rights reserved all rights reserved"), (3, "acc by"), (4, "cc byé"),
            (5, "general public license"), (6, "x general   Public\nLICENSE y cc by")]
    out = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(
        ((i, *brute.licence_base(t)) for i, t in rows), key=key)


def test_simhash(docs, empty):
    want = sorted(brute.components(PAIRS), key=key)
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    stays = simhash.keep_representatives(docs)
    assert stays.columns == docs.columns
    assert stays.count() == len({c for _, _, c in want}) + 1  # id 8 names two components


def test_simhash_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "quite another text")], "doc_id long, text string")
    assert all(r.component_id is None for r in simhash.near_duplicates(docs).collect())
    assert simhash.keep_representatives(docs).count() == 2


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, empty, k):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    shaped = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).select(*own)
    name, stage = corpus_pipeline.STAGES[k]
    for df in (shaped, shaped.limit(0)):
        out = stage(spark, df, "/root/testdata/sf0.001")
        out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == own
