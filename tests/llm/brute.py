"""Plain-Python versions of the operators, written from the contracts."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality_stats(text):
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


def line_dedup(rows, min_docs=10):
    """rows: (id, text) -> [(id, n_lines, n_dropped, kept text)]"""
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip(WS))
    docs = Counter()
    for _, text in rows:
        docs.update({key(x) for x in (text or "").split("\n")} - {""})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (key(x) and docs[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def exact_dedup(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        stays = False
        for i in ids:
            kept = i == keep and not stays
            stays |= kept
            out.append((i, keep, len(ids), kept, sha(text)))
    return out


def shards(rows, n=24):
    sized = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, at, slots, out = sum(r[1] for r in sized), 0, Counter(), []
    for i, size, crc in sized:
        s = (2 * at + size) * n // (2 * total)
        out.append((i, size, crc, s, slots[s]))
        slots[s] += 1
        at += size
    return out


def archive(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        first[p] = min(first.get(p, i), i)
    return [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
             "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in payloads]


def licence_base(text):
    low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return (len(w), len(starts), min(starts) if starts else None, max(starts) if starts else None,
            ",".join(sorted(labels)))


def fingerprint(text, shingle=3):
    w = [re.sub(r"[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def components(rows, shingle=3, bits=3):
    """rows: (id, text) -> {(id, fingerprint hex, component id)} by union-find over all pairs."""
    fps = [fingerprint(t, shingle) for _, t in rows]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    distinct = list(parent)
    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= bits:
                parent[find(distinct[a])] = find(distinct[b])
    first = {}
    for (i, _), f in zip(rows, fps):
        r = find(f)
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return [(i, f"{f:016x}", first.get(find(f))) for (i, _), f in zip(rows, fps)]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]
