"""Line dedup by sharded minimal perfect hashes.

1. Every line's key (stripped, A-Z lower-cased) is hashed to 128 bits; a
   document lists each key hash once, so counting them counts documents.
2. Distinct hashes are dealt to shards by hash.  Each shard builds a minimal
   perfect hash over its hashes, and stores at each hash's slot a 32-bit
   fingerprint and a one-byte document count that saturates at the threshold:
   some 6 bytes a line instead of the line.
3. Documents probe the arrays: (row key, line hash) probes stream past their
   shard's arrays, sorted so that the arrays arrive first.  A line that is in
   a third of all documents is spread over ``salts`` copies of its shard.
   Only probes of frequent lines come back, per document.
4. Documents drop their frequent lines.

No line text is shuffled or joined, and no task holds more than one shard's
arrays and one batch of probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import WS_CHARS, row_key, stage

_STRIP = WS_CHARS.encode()
#: Odd multipliers of the 64-bit finaliser (splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def line_hash(line: str, min_chars: int = 1) -> tuple[int, int] | None:
    """Signed 64-bit halves of the key's hash; None for a shorter key."""
    key = line.encode("utf-8", "surrogatepass").strip(_STRIP).lower()
    if not key or min_chars > 1 and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each hash in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = hi ^ (lo + np.uint64((level + 1) * _STEP & (2**64 - 1)))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit hashes.

    Level by level, hashes that are alone in their position of a bit array of
    twice their number set the bit; the others go on to the next level.  The
    slot of a hash is the rank of its bit over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) + (before - 1)
            self.ranks.append(ranks.astype(np.int32))
            before = int(ranks[-1]) + 1
        self.size = before

    @staticmethod
    def build(hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(hi):
            size = 2 * len(hi)
            at = _slots(hi, lo, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            on = ~alone[at]
            hi, lo = hi[on], lo[on]
        return PerfectHash(levels)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot per hash; -1 for a hash that meets no set bit (not indexed)."""
        out = np.full(len(hi), -1, dtype=np.int64)
        left = np.arange(len(hi))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _slots(hi[left], lo[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dumps(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(b).tobytes() for b in self.levels), [len(b) for b in self.levels]

    @staticmethod
    def loads(packed: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(packed[at:at + n], np.uint8), count=size).astype(bool))
            at += n
        return PerfectHash(levels)


def _fingerprint(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((lo ^ (hi * _M2)) >> np.uint64(32)).astype(np.uint32)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, hi, lo): the distinct line-key hashes of every document."""
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"),
                        F.col(text_col).alias("text")).select("key.a", "key.b", "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b, hi, lo = [], [], [], []
            for key_a, key_b, text in zip(batch["a"], batch["b"], batch["text"]):
                found = {line_hash(x, min_chars) for x in (text or "").split("\n")} - {None}
                a += [key_a] * len(found)
                b += [key_b] * len(found)
                hi += [h[0] for h in found]
                lo += [h[1] for h in found]
            yield pd.DataFrame({"a": a, "b": b, "hi": hi, "lo": lo}, dtype="int64")

    return keyed.mapInPandas(split, "a long, b long, hi long, lo long")


def build_index(hashes: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """One row per shard: its minimal perfect hash and arrays."""
    counts = (hashes.groupBy("hi", "lo").agg(F.count("*").alias("n"))
              .withColumn("shard", F.pmod("hi", F.lit(n_shards)).cast("int")))
    top = min(min_docs, 255)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (pdf[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        mph = PerfectHash.build(hi, lo)
        at = mph.slots(hi, lo)
        prints, tops = np.empty(len(at), np.uint32), np.empty(len(at), np.uint8)
        prints[at] = _fingerprint(hi, lo)
        tops[at] = np.minimum(pdf["n"].to_numpy() * top // min_docs, top)  # `top` says min_docs or more
        packed, sizes = mph.dumps()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "bits": [packed], "sizes": [sizes],
                             "prints": [prints.tobytes()], "counts": [tops.tobytes()]})

    return counts.groupBy("shard").applyInPandas(
        build, "shard int, bits binary, sizes array<long>, prints binary, counts binary")


def frequent_lines(hashes: DataFrame, index: DataFrame, n_shards: int, min_docs: int, salts: int) -> DataFrame:
    """(a, b, hi, lo) of the probes whose line is in ``min_docs`` documents or more."""
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"),
        # Zeros, not nulls: pandas turns long columns with nulls into floats.
        *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "hi", "lo")], "bits", "sizes", "prints", "counts")
    probes = hashes.select(
        F.pmod("hi", F.lit(n_shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("salt"), "a"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        "a", "b", "hi", "lo", F.lit(None).cast("binary").alias("bits"),
        F.lit(None).cast("array<long>").alias("sizes"), F.lit(None).cast("binary").alias("prints"),
        F.lit(None).cast("binary").alias("counts"))
    top = min(min_docs, 255)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mph = prints = tops = None
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            starts = np.flatnonzero(kinds == 0).tolist()
            for begin, end in zip([0, *starts], [*starts, len(batch)]):
                if begin < end and kinds[begin] == 0:
                    row = batch.iloc[begin]
                    mph = PerfectHash.loads(row["bits"], [int(s) for s in row["sizes"]])
                    prints = np.frombuffer(row["prints"], np.uint32)
                    tops = np.frombuffer(row["counts"], np.uint8)
                    begin += 1
                if begin >= end:
                    continue
                part = batch.iloc[begin:end][["a", "b", "hi", "lo"]]
                hi, lo = (part[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
                at = mph.slots(hi, lo)
                yield part[(at >= 0) & (prints[at] == _fingerprint(hi, lo)) & (tops[at] >= top)]

    return (arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
            .mapInPandas(probe, "a long, b long, hi long, lo long"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1, lines_per_shard: int = 1 << 18, salts: int = 8) -> DataFrame:
    """row (struct of all columns), n_lines, n_dropped, kept (text): one row
    per input row.

    A line's key is the line stripped of ASCII white space with A-Z
    lower-cased.  Keys of at least ``min_chars`` code points that occur in at
    least ``min_docs`` documents (rows, each counted once) lose all their
    lines everywhere; blank lines stay.  Null text is one empty line; a
    repeated row counts as a document and loses the same lines.
    """
    hashes = stage(line_hashes(docs, id_col, text_col, min_chars), "lines")
    n_shards = max(1, -(-hashes.count() // lines_per_shard))
    index = stage(build_index(hashes, n_shards, min_docs), "line-index")
    # Duplicate rows ask the same: collect_set holds each line once, and a
    # document's set is no larger than the document.
    drops = (frequent_lines(hashes, index, n_shards, min_docs, salts)
             .groupBy("a", "b").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
             .select(F.struct("a", "b").alias("key"), "drops"))
    whole = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    joined = whole.join(drops, "key", "left")

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops):
            lines = (text or "").split("\n")
            if drop is None:
                out.append((len(lines), 0, text or ""))
                continue
            gone = {(d["hi"], d["lo"]) for d in drop}
            left = [x for x in lines if line_hash(x, min_chars) not in gone]
            out.append((len(lines), len(lines) - len(left), "\n".join(left)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return joined.select("row", cut(F.col("row")[text_col], F.col("drops")).alias("cut")).select("row", "cut.*")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents (all their columns) with their frequent lines dropped."""
    return drop_lines(docs, id_col, text_col, **options).select(*[
        F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
