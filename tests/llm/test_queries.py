"""Every registered corpus query against brute force on the whole of sf0.01."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
import tiktoken
from llm_data import SF001, documents, pages  # noqa: F401

from stationlake.llm import bpe, html_diff, license_rules, packing, quality_rules, queries


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def run(spark, prefix):
    return next(f for name, f in queries.REGISTRY.items() if name.startswith(prefix))(spark, SF001)


def test_op1_statistics_and_verdicts(spark, documents):
    df = run(spark, "op1_").cache()
    got = rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute.quality_stats(t)) for i, t in documents), key=repr)
    rows = df.collect()
    assert all(r.rule == "base" and not r.kept for r in rows if r.base_failed)
    assert all(r.kept == (r.rule is None) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    good = [k for k, q in judged if q == 1]
    bad = [k for k, q in judged if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(not k for k in bad) >= 0.95 * len(bad)


def test_op1_holds_out(spark):
    """Rules learned on half of the labels judge the other half (sf0.1)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality_rules.judge(docs, labels.where("doc_id % 2 = 1")).where("not base_failed")
    kept = {r.id: r.kept for r in judged.collect()}
    test = [(kept[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 0").collect() if r.doc_id in kept]
    assert sum(k for k, q in test if q) >= 0.99 * sum(q for _, q in test)
    assert sum(not k for k, q in test if not q) >= 0.9 * sum(not q for _, q in test)


def test_op2(spark, documents):
    want = [(i, n, d, brute.sha(t)) for i, n, d, t in brute.line_dedup(documents)]
    assert sum(w[2] for w in want) > 0
    assert rows_of(run(spark, "op2_"), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_op3(spark, documents):
    got = rows_of(run(spark, "op3_"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.exact_dedup(documents), key=repr)


def test_op4_equals_the_tokenizer_library(spark, documents):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in documents:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))),
                     hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    assert rows_of(run(spark, "op4_"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op5(spark, documents):
    got = rows_of(run(spark, "op5_"), "doc_id", "size", "text_crc32", "shard", "slot")
    assert got == sorted(brute.shards(documents), key=repr)
    size = Counter()
    for _, n, _, s, _ in got:
        size[s] += n
    assert max(size.values()) - min(size.values()) <= 2 * max(r[1] for r in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op6_is_the_article(spark, sf):
    """The generator's pages: blocks of the article element, nothing else."""
    folder = f"/root/testdata/{sf}"
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r for r in queries.REGISTRY["op6_html_text"](spark, folder).collect()}
    assert len(got) == len(pages)
    import html
    for i, url, page in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        assert got[i].text == "\n".join(x for x in lines if x)
        assert got[i].n_chars == len(got[i].text)


def test_op6_pairs_and_shared_lines(spark, pages):
    """Neighbours by URL over the whole table, against a plain sort."""
    df = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r.n_shared for r in html_diff.extract_text(df).collect()}
    by_host = defaultdict(list)
    for i, url, page in pages:
        m = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", url)
        by_host[m[1].lower()].append((m[2], url, i, [x for _, x in html_diff.lines_of(page)]))
    for group in by_host.values():
        group.sort()
        keys = [g[:2] for g in group]
        if len(set(keys)) < len(keys):
            continue  # order among equal URLs is free
        for k, (path, _, i, lines) in enumerate(group):
            near = [(html_diff._nearness(path, g[0]), -d, g) for d, g in
                    ((0, group[k - 1] if k else None), (1, group[k + 1] if k + 1 < len(group) else None)) if g]
            want = brute.lcs_length(lines, max(near, key=lambda x: x[:2])[2][3]) if near else 0
            assert got[i] == want


def test_op7(spark, pages):
    got = rows_of(run(spark, "op7_"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.archive([(i, h) for i, _, h in pages]), key=repr)


def test_op8_covers_every_text_within_budget(spark, documents):
    rows = run(spark, "op8_").collect()
    spans = defaultdict(list)
    batches = Counter()
    for r in rows:
        spans[r.doc_id].append((r.start, r.n_tokens))
        assert r.n_tokens <= r.bucket_tokens
        batches[r.bucket, r.bucket_tokens, r.batch] += 1
    assert all(n * tokens <= 65536 for (_, tokens, _), n in batches.items())
    for i, t in documents:
        n, at = len(brute.words(t)), 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == n
    for (b, tokens, batch), n in batches.items():  # only the last batch of a bucket is short
        assert n == 65536 // tokens or (b, tokens, batch + 1) not in batches
    slots = Counter((r.bucket, r.batch, r.slot) for r in rows)
    assert max(slots.values()) == 1
    # No other choice of eight bounds pads less.
    hist = defaultdict(lambda: [0, 0])
    for r in rows:
        step = max(1, r.n_tokens)
        hist[step][0] += 1
        hist[step][1] += r.n_tokens
    padding = sum(r.bucket_tokens - r.n_tokens for r in rows)
    bounds = packing.optimal_bounds(sorted((k, *v) for k, v in hist.items()), 8)
    assert padding == sum(min(b for b in bounds if b >= k) * v[0] - v[1] for k, v in hist.items())


def test_op9_base(spark, documents):
    df = run(spark, "op9_")
    got = rows_of(df, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute.licence_base(t)) for i, t in documents), key=repr)
    for r in df.collect():
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def brute_licences(text):
    """Labels, detections and score by the definition: all pairs of intervals."""
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f" {text} ")
    found = [(m.start(), m.end(), c, label, weight) for c, label, keyword, e, weight in license_rules.rules() if keyword in norm
             for m in re.finditer(e, norm)]

    def inside(x, y):
        """Whether ``y`` suppresses ``x``."""
        if not (y[0] <= x[0] and x[1] <= y[1]) or y[2] > x[2]:
            return False
        return y[2] < x[2] or y[:2] != x[:2] or y[3] < x[3]
    left = {x for x in found if not any(inside(x, y) for y in found)}
    base = {label for phrase, label in license_rules.BASE if f" {phrase} " in norm}
    return (",".join(sorted({x[3] for x in left} | base)), len(left), max([x[4] for x in left] + [0.8] * bool(base) + [0.0]))


def test_op9_labels_and_score(spark, documents):
    rows = documents + [(10**6, "GPL v3 or later, gnu gpl, lgpl 2.1; MIT License " * 40), (10**6 + 1, "\u212a licence cc \u212a by gp\u0130 mit license"),
                        (10**6 + 2, " ".join(x[3].replace("(?<= )(?:", "").replace(")(?= )", "") for x in license_rules.rules()[:90]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = rows_of(license_rules.scan(df), "doc_id", "labels", "n_detections", "score")
    assert got == sorted(((i, *brute_licences(t)) for i, t in rows), key=repr)


def test_op9_one_text_of_many_matches(spark):
    def scan(n):
        start = time.perf_counter()
        rows = license_rules.scan(spark.createDataFrame([(1, "gpl x cc by " * n)], "doc_id long, text string")).collect()
        return rows[0], time.perf_counter() - start
    scan(10)
    (_, few), (row, many) = scan(1000), scan(64000)
    assert row.n_detections == 64000 and row.n_base == 64000 and row.labels == "cc-by,gpl"
    assert many - few < 10  # the square would take minutes


def test_op10(spark, documents):
    got = rows_of(run(spark, "op10_"), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.components(documents), key=repr)


@pytest.mark.parametrize("name", [n for n in queries.REGISTRY if n.startswith(("op1_", "op3_", "op9_"))])
def test_native_plans_have_no_python(spark, name):
    plan = queries.REGISTRY[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
