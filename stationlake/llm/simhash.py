"""SimHash near-duplicates by pigeonhole blocks.

1. Every whole text gets a 64-bit fingerprint: the bitwise majority of the
   64-bit hashes of its word shingles.
2. Distinct fingerprints are cut into ``n_blocks`` blocks.  Two that differ
   in at most ``max_bits`` bits agree on at least ``n_blocks - max_bits``
   blocks, so each is filed once per choice of that many blocks and close
   pairs share a file.  With 6 blocks and 3 bits a file has 32 bits of key.
3. Inside a file members are compared by XOR and bit count.  Only a spanning
   forest of the links leaves the task, never all pairs; a file with more than
   ``tile`` members is cut into tiles, and every pair of tiles is compared
   in a task of its own.
4. Connected components: labels fall to the smallest neighbour's label and
   jump along labels until nothing changes, each round staged in the shared
   checkpoint folder.

Copies share a fingerprint and are collapsed to one node first, by salted
groups, so a group of any size is one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import row_key, stage, stage_at, unstage

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority fingerprint of a text (unsigned); zero without words.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are
    joined by one space, repeats included; a text with fewer words than
    ``shingle`` is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(view[a:b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 65536):  # bounded memory for very long texts
        part = values[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, key, fp (the fingerprint's bits as a signed long) for every row."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
                       simhash(F.col(text_col)).alias("fp"))


def _masks(n_blocks: int, max_bits: int) -> list[int]:
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(n_blocks)]
    return [sum(c) for c in combinations(blocks, n_blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, max_bits: int, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the graph "at most ``max_bits``
    bits apart"; with ``split`` only pairs across that index count.

    Breadth-first: each member is compared with the members not reached yet,
    so at most len - 1 pairs come out.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if split is not None:
                near &= (left < split) != (at < split)
            if near.any():
                reached = left[near]
                left = left[~near]
                links.extend((at, int(i)) for i in reached)
                frontier.extend(int(i) for i in reached)
    return links


def links(fps: DataFrame, max_bits: int, n_blocks: int, tile: int) -> DataFrame:
    """(a, b) pairs of fingerprints at most ``max_bits`` bits apart whose
    components are those of the full link graph.  ``fps``: distinct ``fp``."""
    masks = _masks(n_blocks, max_bits)
    filed = fps.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"))
    sizes = filed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = filed.join(sizes, ["choice", "key"])
    # A small file is the tile pair (0, 0); a member of a large one goes to
    # every pair that its own tile is part of.
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.col("tiles")).cast("int")
    dealt = (shared.withColumn("tiles", tiles).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("choice", "key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
                     "own", "fp"))
    group = ["choice", "key", "t1", "t2"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows come in; groups may cross batches."""
        def found(own_tile: np.ndarray, members: np.ndarray, across: bool) -> list[tuple[int, int]]:
            if across:
                order = np.argsort(own_tile, kind="stable")
                members, split = members[order], int((own_tile == own_tile.min()).sum())
                if split == len(members):
                    return []
            else:
                split = None
            return [(int(members[i].astype(np.int64)), int(members[j].astype(np.int64)))
                    for i, j in spanning_links(members, max_bits, split)]

        kept: pd.DataFrame | None = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            if not len(batch):
                continue
            keys = batch[group].to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *change.tolist()]
            members, own_tile = batch["fp"].to_numpy().view(np.uint64), batch["own"].to_numpy()
            out = [pair for a, b in zip(edges, edges[1:])
                   for pair in found(own_tile[a:b], members[a:b], keys[a][2] != keys[a][3])]
            kept = batch.iloc[edges[-1]:].reset_index(drop=True)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if kept is not None and len(kept):
            row = kept.iloc[0]
            out = found(kept["own"].to_numpy(), kept["fp"].to_numpy().view(np.uint64), row["t1"] != row["t2"])
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return (dealt.repartition(*group).sortWithinPartitions(*group)
            .mapInPandas(verify, "a long, b long").distinct())


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs``; root is the smallest node
    of the component.

    A round lowers each label to the smallest label next to it and then to the
    label of that label, until a round moves none.  It reads the staged labels
    of the round before; older ones are deleted.
    """
    spark = pairs.sparkSession
    edges = stage(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
                  .unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    labels, path = stage_at(edges.groupBy("x").agg(F.min("y").alias("m"))
                            .select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    while True:
        lower = (edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("m"))
                 .join(labels, F.col("x") == F.col("node"))
                 .select("node", F.least("root", "m").alias("low"), "root"))
        jump = lower.join(labels.select(F.col("node").alias("at"), F.col("root").alias("far")),
                          F.col("low") == F.col("at"), "left")
        nxt, nxt_path = stage_at(jump.select("node", F.least("low", "far").alias("root"),
                                             (F.least("low", "far") < F.col("root")).alias("moved")), "labels")
        moved = nxt.where("moved").limit(1).count()
        unstage(spark, path)
        labels, path = nxt.select("node", "root"), nxt_path
        if not moved:
            return labels


def _clustered(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, n_blocks: int,
               tile: int, salts: int) -> DataFrame:
    """id, key (row key), fp, root (smallest fingerprint of the component),
    component_id (its smallest id) for every row."""
    rows = stage(fingerprints(docs, id_col, text_col, shingle)
                 .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts))), "fingerprints")
    # A fingerprint has at most `salts` entries, whatever its number of rows.
    entries = stage(rows.groupBy("fp", "salt").agg(F.min("id").alias("first")), "entries")
    nodes = entries.groupBy("fp").agg(F.min("first").alias("first"))
    roots = components(links(nodes.select("fp"), max_bits, n_blocks, tile))
    rooted = (nodes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = entries.select("fp", "salt").join(rooted.join(ids, "root").drop("first"), "fp")
    return rows.join(named, ["fp", "salt"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, n_blocks: int = 6, tile: int = 4096, salts: int = 64) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id: one row per row.

    Rows whose fingerprints are linked, directly or through others, share a
    component; its id is the smallest id in it.  Null and blank texts have
    fingerprint zero and link like any other.  A null id names no component
    (component_id is null if all its ids are); repeated rows each come out.
    An empty table gives an empty result.
    """
    found = _clustered(docs, id_col, text_col, shingle, max_bits, n_blocks, tile, salts)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 3, n_blocks: int = 6, tile: int = 4096, salts: int = 64) -> DataFrame:
    """The documents (all their columns) that stay: one row per component.

    The row with the smallest id stays (null ids last, ties by row key); rows
    equal in id and text are one document.
    """
    found = _clustered(docs, id_col, text_col, shingle, max_bits, n_blocks, tile, salts)
    stays = (found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("s"))
             .select("s.key.a", "s.key.b"))
    whole = docs.select(F.struct("*").alias("_row"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    # Joined on the key's halves, the rows are already partitioned and sorted
    # for the last step; a struct key would be shuffled again.
    return (whole.select("_row", "key.a", "key.b").join(stays, ["a", "b"], "left_semi")
            .dropDuplicates(["a", "b"]).select("_row.*"))
