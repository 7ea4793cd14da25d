"""Conversation prefix trie by burst tries.

1. A turn id is the 128-bit hash of a turn's (role, text).  A conversation is
   the string of its turn ids, one thin row; copies collapse to one row with
   their smallest id, their number and the hash of their ids.
2. All strings start in the container of the root.  A container with more
   strings than ``limit`` bursts: it becomes a trie head, strings that end
   there stay with it, and the others go to containers named by their next
   turn id.  Rounds go on until no container is oversized; only rows of
   oversized ones move again.  Big heads are matched under salted keys.
3. The remaining containers are sorted and swept: a stack of open nodes
   follows the strings, and a node closes, its sums complete, when a string
   leaves it.  A task holds the open nodes and the closed children of one
   container, at most ``limit`` strings' worth.
4. Heads add up their containers and the heads below them, deepest first.

No text is shuffled; a conversation's row has some 20 bytes a turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import stage, words_of

ID = 16  # bytes of a turn id
ROOT = bytes(ID)
NO_ENDS = sha256(b"").hexdigest()
_CHUNK = 512  # ids in a piece of their list

_NODE = ("head binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends string")


def turn_strings(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turn ids (with their words) in turn order.

    Null turns come first; rows of one turn are ordered by their turn id.
    Null role or text is empty.  Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    thin = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).isNotNull().alias("numbered"),
        F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.size(words_of(text)).alias("words"))
    listed = F.sort_array(F.collect_list(F.struct("numbered", "turn", "id", "words")))
    return thin.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["id"], t["words"])).alias("turns"))


def graft(strings: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """Conversations rebuilt on their block's first one: conversation c takes
    the first h turns of conversation c - c % ``every`` (h: CRC-32 of its
    decimal id, modulo ``shared``) in place of its own first h turns."""
    block = F.col("conv_id") - F.col("conv_id") % every
    first = (strings.filter(F.col("conv_id") % every == 0)
             .select(F.col("conv_id").alias("_block"), F.slice("turns", 1, shared - 1).alias("_first")))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    none = F.array().cast("array<struct<id:string,words:int>>")
    return (strings.withColumn("_block", block).join(first, "_block", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("_first", none), F.lit(1), h),
                                        F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


def _ends(rows: DataFrame) -> DataFrame:
    """path, ends: SHA-256 of the ids of each path's conversations, ascending.

    The ids are sorted over all tasks; each task joins its own into pieces,
    and only pieces meet to be hashed one after the other, as the hash demands.
    """
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, n, path, ids = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            out = []
            for own, conv_id in zip(batch["path"], batch["conv_id"]):
                if own != path or len(ids) == _CHUNK:
                    if ids:
                        out.append((path, pid, n, ",".join(ids)))
                    path, ids, n = own, [], n + 1
                ids.append(str(conv_id))
            yield pd.DataFrame(out, columns=["path", "pid", "n", "piece"])
        if ids:
            yield pd.DataFrame([(path, pid, n, ",".join(ids))], columns=["path", "pid", "n", "piece"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = h = None
        for batch in batches:
            out = []
            for own, piece in zip(batch["path"], batch["piece"]):
                if own == path:
                    h.update(b"," + piece.encode())
                    continue
                if h is not None:
                    out.append((path, h.hexdigest()))
                path, h = own, sha256(piece.encode())
            yield pd.DataFrame(out, columns=["path", "ends"])
        if h is not None:
            yield pd.DataFrame({"path": [path], "ends": [h.hexdigest()]})

    pieces = (rows.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
              .mapInPandas(join, "path string, pid int, n int, piece string"))
    return (pieces.repartition("path").sortWithinPartitions("path", "pid", "n")
            .mapInPandas(digest, "path string, ends string"))


def distinct_strings(strings: DataFrame) -> DataFrame:
    """ids (binary), words, conv_id (smallest), n, ends: one row per distinct string."""
    rows = stage(strings.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("ids"),
                                F.col("turns.words").alias("words"))
                 .withColumn("path", F.md5("ids")), "trie-strings")
    return (rows.groupBy("path", "ids", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
            .join(_ends(rows), "path").drop("path"))


def _salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str) -> DataFrame:
    """Equi-join whose hot keys of ``left`` are spread: ``right``, with one
    row per key, is repeated for every salt."""
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (left.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
            .join(repeated, [key, "_salt"], how).drop("_salt"))


def burst(strings: DataFrame, limit: int, salts: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The containers (strings with ``head``, the container's name, ``parent``,
    its trie head, and ``depth``), and per round the trie heads (head, parent,
    words) with the strings that end at them."""
    spark = strings.sparkSession
    opened = stage(strings.select(F.lit(ROOT).alias("head"), F.lit(0).alias("depth"), "*"), "trie-open")
    heads = spark.createDataFrame([(bytearray(ROOT), None, 0)] if opened.take(1) else [],
                                  "head binary, parent binary, words int")
    settled, rounds = None, []
    while True:
        at_end = F.octet_length("ids") == F.col("depth") * ID
        rounds.append((heads, opened.filter(at_end)))
        so_far = F.substring("ids", 1, len(rounds) * ID)
        moved = stage(opened.filter(~at_end).select(
            F.unhex(F.md5(so_far)).alias("head"), F.col("head").alias("parent"), F.lit(len(rounds)).alias("depth"),
            *strings.columns), "trie-moved")
        sizes = moved.groupBy("head", "parent").agg(
            F.count("*").alias("_n"), F.min(F.col("words")[len(rounds) - 1]).alias("_words"))
        big = stage(sizes.filter(F.col("_n") > limit).select("head", "parent", F.col("_words").alias("words")),
                    "trie-heads")
        if not big.take(1):
            return (moved if settled is None else settled.unionByName(moved)), rounds
        split = _salted(moved, big.select("head", F.lit(True).alias("_big")), "head", salts, "left")
        small = split.filter(F.col("_big").isNull()).drop("_big")
        settled = small if settled is None else settled.unionByName(small)
        opened = split.filter("_big").drop("_big", "parent")
        heads = big


class _Open:
    """A node that strings still pass through."""

    __slots__ = ("conv_id", "n", "children", "leaves", "saved", "words", "ends", "closed")

    def __init__(self, words: int):
        self.conv_id, self.words, self.ends = None, words, NO_ENDS
        self.n = self.children = self.leaves = self.saved = 0
        self.closed: list[list] = []

    def add(self, conv_id: int, n: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n += n


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of sorted containers.  The top node of a container names its
    trie head; the others know their parent."""
    columns = [f.strip().split(" ")[0] for f in _NODE.split(",")]
    head = parent = None
    top, path = 0, b""
    stack: list[_Open] = []  # nodes of depth top, top + 1, ...

    def close(depth: int, out: list) -> None:
        """Close the nodes deeper than ``depth``."""
        while stack and top + len(stack) - 1 > depth:
            node = stack.pop()
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
            row = [None, node.conv_id, top + len(stack), None, node.n, node.children, leaves, saved, node.ends]
            for child in node.closed:
                child[3] = node.conv_id
            out += node.closed
            if stack:
                up = stack[-1]
                up.add(node.conv_id, node.n)
                up.children += 1
                up.leaves += leaves
                up.saved += saved
                up.closed.append(row)
            else:
                row[0] = parent
                out.append(row)

    for batch in batches:
        out: list[list] = []
        for own, its_parent, depth, ids, words, conv_id, n, ends in zip(*(batch[c] for c in (
                "head", "parent", "depth", "ids", "words", "conv_id", "n", "ends"))):
            own, ids = bytes(own), bytes(ids)
            if own != head:
                close(-1, out)
                head, parent, top, path = own, its_parent, depth, b""
            same = 0
            for same in range(0, min(len(ids), len(path)) + 1, ID):
                if ids[same:same + ID] != path[same:same + ID] or same == len(path):
                    break
            close(same // ID, out)
            for k in range(top + len(stack), len(ids) // ID + 1):
                stack.append(_Open(int(words[k - 1])))
            stack[-1].add(conv_id, n)
            stack[-1].ends, path = ends, ids
        yield pd.DataFrame(out, columns=columns, dtype=object)
    out = []
    close(-1, out)
    yield pd.DataFrame(out, columns=columns, dtype=object)


def trie_nodes(strings: DataFrame, limit: int = 256, salts: int = 16) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256: the nodes of the prefix trie of ``strings``
    (conv_id, turns as `turn_strings` gives them).

    A node is named by its smallest conversation and its depth.  The result
    does not depend on ``limit`` (strings of a container) or ``salts``.
    """
    containers, rounds = burst(distinct_strings(strings), limit, salts)
    swept = stage(containers.repartition("head").sortWithinPartitions("head", "ids")
                  .mapInPandas(_sweep, _NODE), "trie-nodes")
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    below = swept.filter(F.col("head").isNotNull())
    tops, heads = below, []
    for depth in range(len(rounds) - 1, -1, -1):
        own, ended = rounds[depth]
        parts = below.filter(F.col("depth") == depth + 1).select(
            "head", "conv_id", "n_convs", F.lit(1).alias("n_children"), "n_leaves", "saved_tokens",
            F.lit(None).cast("string").alias("ends")).unionByName(ended.select(
                "head", "conv_id", F.col("n").alias("n_convs"), F.lit(0).alias("n_children"), F.lit(0).alias("n_leaves"),
                F.lit(0).alias("saved_tokens"), "ends"))
        sums = parts.groupBy(F.col("head").alias("_head")).agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in numbers], F.max("ends").alias("ends"))
        done = stage(own.join(sums, own["head"] == sums["_head"]).select(
            F.col("_head"), F.col("parent").alias("head"), "conv_id", F.lit(depth).alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")), "trie-sums")
        heads.append(done.select(F.col("_head").alias("head"), F.col("conv_id").alias("_parent")))
        below = below.unionByName(done.drop("_head"))
        tops = tops.unionByName(done.drop("_head"))
    named = heads[0]
    for more in heads[1:]:
        named = named.unionByName(more)
    topped = (_salted(tops.filter(F.col("head").isNotNull()), named, "head", salts, "inner")
              .withColumn("parent_conv_id", F.col("_parent")))
    nodes = swept.filter(F.col("head").isNull())
    for part in (topped, tops.filter(F.col("head").isNull())):
        nodes = nodes.unionByName(part.select(nodes.columns))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *numbers,
                        F.col("ends").alias("ends_sha256"))
