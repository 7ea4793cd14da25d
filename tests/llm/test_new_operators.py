"""Mixing, conversation trie and vector codes against brute-force versions:
nulls, ties, repeated rows, empty tables, clashing columns, small limits."""

import math
import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from stationlake.llm import conversation_trie as trie
from stationlake.llm import mixing, vector_codes


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- mixing ---------------------------------------------------------------

def brute_targets(sizes, weights, share, cap):
    """Round by round, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    clamped, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in clamped]
        left = budget - sum(cap * sizes[s] for s in clamped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target | {s: cap * sizes[s] for s in clamped}
        clamped |= above


DOCS = ([(k, "w " * (k % 17), ["b", "a", "Z", None, "é"][k % 5]) for k in range(400)]
        + [(7, "w w w", "b"), (7, "w w w", "b"), (None, "x y", "a"), (None, None, None), (900, "long " * 20000, "Z"),
           (901, "", "empty"), (902, None, "empty")])


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in (
        "id", "size", "row", "_row", "_pid", "_pos", "place", "whole", "extra", "weight", "cap", "target", "no_source", "offset")})


@pytest.mark.parametrize("share,cap", [(1.5, 2.0), (0.3, 2.0), (3.0, 2.0), (1.5, 4.0)])
def test_mix(mixed, share, cap):
    plan = mixing.plan_mix(mixed, share=share, max_epochs=cap).collect()
    assert sorted((repr(r.doc_id), repr(r.source), r["size"]) for r in plan) == sorted(
        (repr(i), repr(s), len(words(t))) for i, t, s in DOCS)
    sizes = defaultdict(int)
    for i, t, s in DOCS:
        sizes[s] += len(words(t))
    want = brute_targets(sizes, (5, 2, 1), min(share, cap), cap)
    taken = defaultdict(int)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.whole * r["size"] + r.extra <= cap * r["size"]
        assert r.whole == (math.floor(r.target / r.source_size) if r.source_size else 0)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    assert sum(want.values()) == pytest.approx(min(share, cap) * sum(sizes.values()))


def test_mix_order_and_reruns(mixed):
    plan = mixing.plan_mix(mixed)
    assert rows_of(plan, *plan.columns) == rows_of(mixing.plan_mix(mixed.repartition(3)), *plan.columns)
    by = defaultdict(list)
    for r in plan.collect():
        by[r.source].append(r)
    for source, rows in by.items():  # an extra copy goes to the first in the seeded order
        rows.sort(key=lambda r: (md5(f"11{'' if r.doc_id is None else f':{r.doc_id}'}".encode()).hexdigest(), r["size"]))
        part = [r.extra / r["size"] for r in rows if r["size"]]
        assert part == sorted(part, reverse=True) and sum(0 < p < 1 for p in part) <= 1
    assert mixing.plan_mix(mixed.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.plan_mix(mixed, weights=(1, 0))


def test_mixture(mixed):
    plan = {}
    for r in mixing.plan_mix(mixed).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.taken
    got, texts = defaultdict(int), {(i, s): t for i, t, s in DOCS}
    for r in mixing.mixture(mixed).collect():
        key = r.row.doc_id, r.row.source
        assert r.row._row == "clash"
        got[key] += len(words(r.text))
        assert r.text == texts[key] or words(texts[key])[:len(words(r.text))] == words(r.text)
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in plan.items() if n}
    assert mixing.mixture(mixed.limit(0)).count() == 0


# ---- conversation trie ----------------------------------------------------

def brute_strings(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own = md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append(((t is not None, t or 0, own), (role, text)))
    return {c: [x[1] for x in sorted(ts)] for c, ts in by.items()}


def brute_graft(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    return out


def brute_nodes(strings):
    members = defaultdict(list)
    for c, ts in strings.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    fans = defaultdict(int)
    for p in members:
        if p:
            fans[p[:-1]] += 1
    cost = {p: (len(m) - 1) * len(words(p[-1][1])) if p else 0 for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), fans[p],
                    sum(not fans[x] for x in below[p]), sum(cost[x] for x in below[p]),
                    sha256(",".join(map(str, sorted(c for c in m if len(strings[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def chats(seed):
    """Shared openings, copies, a very long conversation, nulls, repeated rows, gaps in the blocks."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 260), 200):
        opening = rnd.choice(["sys a", "sys b", "sys a"])
        n = rnd.choice([1, 1, 2, 3, 5])
        for t in range(n):
            text = opening if t == 0 else rnd.choice(["yes", "no no", None, f"own {rnd.randrange(9)}"])
            rows.append((c, rnd.choice([t, t, t, None]) if seed == 2 else t, rnd.choice(["user", None, ""]) if t else "user", text))
    rows += [(1000, t, "user", f"turn {t}") for t in range(150)] + [(1001, t, "user", f"turn {t % 149}") for t in range(150)]
    rows += [(1020 + k, t, "user", "copy") for k in range(80) for t in range(3)]
    rows += [(1003, 0, "user", "x y z" * 9000), (None, 0, "user", "nobody"), (1004, 1, "u", "same"), (1004, 1, "u", "same")]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 1), (1, 5), (2, 3), (2, 10**6)])
def test_trie(spark, seed, limit):
    rows = chats(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "ids", "n", "head", "words", "path", "ends", "depth", "turns")})
    if limit == 1:  # every shared prefix bursts: the long ones would take a round a turn
        df = df.filter("conv_id is null or conv_id not in (1000, 1001)")
        rows = [r for r in rows if r[0] not in (1000, 1001)]
    own = brute_strings(rows)
    strings = trie.turn_strings(df)
    assert rows_of(trie.trie_nodes(strings, limit=limit, salts=3), *NODE) == brute_nodes(own)
    assert rows_of(trie.trie_nodes(trie.graft(strings), limit=limit), *NODE) == brute_nodes(brute_graft(own))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    assert trie.trie_nodes(trie.graft(trie.turn_strings(df.limit(0)))).count() == 0
    lone = spark.createDataFrame([(c, 0, "u", "x") for c in range(21, 40)], df.schema)  # most lose their only turn
    own = brute_strings([(c, 0, "u", "x") for c in range(21, 40)])
    assert rows_of(trie.trie_nodes(trie.graft(trie.turn_strings(lone))), *NODE) == brute_nodes(brute_graft(own))


# ---- vector codes ---------------------------------------------------------

def brute_codes(rows, n_parts=8, k=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][2]) // n_parts
    cut = [[v[p * width:(p + 1) * width] for p in range(n_parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:k]] for p in range(n_parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(n_parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else e for j, e in enumerate(books[p])]
    final = [[nearest(c[p], books[p]) for p in range(n_parts)] for c in cut]
    return sorted(((i, lab, [j for _, j in f], sum(d for d, _ in f)) for (i, lab, _), f in zip(kept, final)), key=repr), books


def vectors(n, dim, seed, kind):
    rnd = np.random.default_rng(seed)
    if kind == "coarse":  # many ties and unused entries
        vs = rnd.integers(-2, 3, (n, dim)) / 4096
    elif kind == "clustered":
        vs = rnd.normal(size=(9, dim))[rnd.integers(0, 9, n)] + rnd.normal(size=(n, dim)) / 20
    else:
        vs = rnd.normal(size=(n, dim)) / 8
    return [(int(i) * 3 + 2**55, [float(x) for x in np.float32(v)], None if i % 7 == 0 else int(i) % 4) for i, v in enumerate(vs)]


@pytest.mark.parametrize("n,dim,kind", [(400, 64, "spread"), (300, 16, "coarse"), (500, 32, "clustered"), (9, 8, "spread")])
def test_codes(spark, n, dim, kind):
    rows = vectors(n, dim, n, kind)
    rows += [(5, None, 1), (6, [], 1), (1, [None] * dim, 1), (2, [float("nan")] + [0.0] * (dim - 1), 1),
             (3, [float("-inf")] + [0.0] * (dim - 1), None)]
    same = [(2**56 + 1, rows[3][1], 2)] * 20
    df = spark.createDataFrame(rows + same, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "ints", "part", "entry", "n", "code", "error", "kind")})
    want, books = brute_codes(rows + same)
    coded, got = vector_codes.train(df)
    assert got.tolist() == books
    assert rows_of(coded, "id", "label", "code", "error") == want
    totals = defaultdict(int)
    for _, lab, _, e in want:
        totals[lab] += e
    assert {(r.label, r.label_error) for r in vector_codes.with_label_errors(coded).collect()} == set(totals.items())


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, [None], 1)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.train(df)
    assert coded.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [1.0] * 12, 1)], df.schema))


def test_bounds_spare_distances():
    """On clustered parts most are certain after the first rounds, and any width gives the plain answer."""
    points = np.array([v for _, v, _ in vectors(600, 8, 3, "clustered")])
    points = np.floor(points * 4096).astype(np.int64)
    for b in (2, 4, 8, 16):
        book, spared = points[:16].copy(), 0
        lists = vector_codes.fresh(points, book, b)
        for n in range(6):
            first = lists.order[:, 0].astype(int)
            moved_book = np.array([points[first == e].sum(0) // max((first == e).sum(), 1) if (first == e).any() else book[e]
                                   for e in range(16)])
            moved = np.sqrt(((moved_book - book) ** 2).sum(1).astype(float))
            book = moved_book
            lists, needed = vector_codes.advance(points, book, moved, lists, vector_codes.next_width(b, [1] * (b + 1), 16) if n == 2 else lists.order.shape[1])
            plain = ((points[:, None] - book[None]) ** 2).sum(2)
            assert (lists.order[:, 0] == plain.argmin(1)).all()
            listed = lists.order.astype(int)
            far = np.sqrt(np.take_along_axis(plain, listed, 1).astype(float))
            assert (lists.bounds[:, 0] >= far[:, 0]).all() and (lists.bounds[:, 1:-1] <= far[:, 1:]).all()
            others = plain.astype(float)
            np.put_along_axis(others, listed, np.inf, 1)
            assert (lists.bounds[:, -1] <= np.sqrt(others.min(1))).all()
            assert needed.sum() == len(points)
            spared += needed[0]
        assert spared > len(points)


def test_width_follows_the_need():
    assert vector_codes.next_width(4, [90, 5, 4, 0, 1], 16) == 3
    assert vector_codes.next_width(4, [100, 0, 0, 0, 0], 16) == 2
    assert vector_codes.next_width(4, [10, 0, 0, 0, 90], 16) == 8
    assert vector_codes.next_width(8, [10] + [0] * 7 + [90], 16) == 8
