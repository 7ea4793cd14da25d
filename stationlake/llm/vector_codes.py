"""Vector code compression: a product quantiser trained in exact integers,
with Drake-Hamerly adaptive bounds.

Vectors are scaled to integers and cut into equal parts; each part position
has a codebook that Lloyd rounds improve.  A round reads every part with what
the last round left of it: its ``b`` closest entries in order, an upper bound
of its distance to the first, lower bounds of its distances to the others and
one outer bound for all entries that are not listed.  Entries move between
rounds, so the bounds are loosened by how far.

- If the upper bound is below every other bound, the part keeps its entry and
  no distance is computed (``certain``).
- Otherwise its own distance is computed and only the listed entries whose
  bound does not exceed it are compared, in integers (``listed``).
- If the outer bound does not exceed it, all entries are compared and the list
  is made anew (``full``).

Bounds are floats with a margin; whatever they leave open is decided by exact
integer distances, ties to the lower index, so the codes are those of plain
Lloyd rounds.  ``b`` adapts per part position to how deep the last round had
to look: bounds that nobody needed are not kept, and a position where many
parts fell back to all entries keeps more.

A round is one pass over the rows: each task writes its rows' new state and
one row of sums per (part, entry); the sums of all tasks give the next
codebooks, which are as small as the parameters make them.  The state is a
table below the checkpoint folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm._base import fresh_folder, stage, stage_at, unstage

#: Scaled components of a larger size could overflow the sums of squares.
LARGEST = 1 << 24
_MARGIN = 1e-3  # of a distance between integer vectors, far above its rounding error


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous array."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(len(rows), 1)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(rows)]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), buffers).cast(pa.binary())


def _rows(column: pa.Array, dtype) -> np.ndarray:
    """The inverse of `_binary`: a two-dimensional array."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, dim: int) -> DataFrame:
    """id, label, ints (little-endian int32): the usable vectors as integers floor(scale * x)."""
    def scale_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"", np.float64) if not len(batch) else np.asarray(
                batch["vector"].flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            ints = np.floor(values.reshape(len(batch), dim) * scale)
            if len(ints) and np.abs(ints).max() > LARGEST:
                raise ValueError(f"a scaled component is beyond {LARGEST}")
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], _binary(ints.astype("<i4"))],
                                             ["id", "label", "ints"])

    kept = usable(vectors, vector_col).filter(F.size(vector_col) == dim).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(scale_batches, f"id {kinds['id']}, label {kinds['label']}, ints binary")


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Without null or empty vectors and vectors with a null, NaN or infinite component."""
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ok)


class Lists:
    """What a round keeps of one part position's rows: ``order`` (rows x b:
    entries, the assigned one first) and ``bounds`` (rows x b + 1: the upper
    bound of the first, lower bounds of the others, the outer bound)."""

    def __init__(self, order: np.ndarray, bounds: np.ndarray):
        self.order, self.bounds = order, bounds


def _square(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    diff = points - entries
    return (diff * diff).sum(axis=-1)


def fresh(points: np.ndarray, book: np.ndarray, b: int) -> Lists:
    """Lists from the distances to all entries."""
    square = _square(points[:, None, :], book[None, :, :])
    order = np.argsort(square, axis=1, kind="stable")  # ties: lower index first
    far = np.sqrt(np.take_along_axis(square, order[:, :b + 1], axis=1).astype(np.float64))
    bounds = np.full((len(points), b + 1), np.inf)
    bounds[:, :far.shape[1]] = far
    return Lists(order[:, :b].astype(np.uint8), bounds)


def advance(points: np.ndarray, book: np.ndarray, moved: np.ndarray, old: Lists, b: int) -> tuple[Lists, np.ndarray]:
    """The lists under the moved codebook, b entries wide, and how many parts
    were certain, needed 1, 2, ... listed entries, or needed all (last)."""
    n, width = old.order.shape
    needed = np.zeros(width + 1, dtype=np.int64)
    order, bounds = old.order.copy(), old.bounds.copy()
    drift = moved[order]
    bounds[:, 0] += drift[:, 0] + _MARGIN
    bounds[:, 1:width] -= drift[:, 1:] + _MARGIN
    bounds[:, width] -= moved.max(initial=0.0) + _MARGIN
    open_ = np.flatnonzero(bounds[:, 0] >= bounds[:, 1:].min(axis=1))
    needed[0] = n - len(open_)
    if len(open_):
        own = _square(points[open_], book[order[open_, 0]])
        bounds[open_, 0] = np.sqrt(own.astype(np.float64)) + _MARGIN
        full = bounds[open_, 0] >= bounds[open_, width]
        at = open_[~full]
        if len(at):
            asked = bounds[at, 1:width] <= bounds[at, :1]
            square = np.full(asked.shape, np.iinfo(np.int64).max)
            i, j = np.nonzero(asked)
            square[i, j] = _square(points[at[i]], book[order[at[i], j + 1]])
            # Exact distances where asked, bounds elsewhere: those are above the winner's.
            found = np.where(asked, np.sqrt(square.astype(np.float64)) - _MARGIN, bounds[at, 1:width])
            best = np.concatenate([own[~full][:, None], square], axis=1)
            # The winner: least integer distance, then lowest index.
            first = np.lexsort((order[at], best), axis=1)[:, 0]
            found = np.concatenate([bounds[at, :1] - 2 * _MARGIN, found], axis=1)
            rest = found.copy()
            rest[np.arange(len(at)), first] = -np.inf
            place = np.argsort(rest, axis=1, kind="stable")
            winner = np.sqrt(best[np.arange(len(at)), first].astype(np.float64)) + _MARGIN
            order[at] = np.take_along_axis(order[at], place, axis=1)
            bounds[at, :width] = np.take_along_axis(found, place, axis=1)
            bounds[at, 0] = winner
            needed += np.bincount(asked.sum(axis=1), minlength=width + 1)[:width + 1]
        again = open_[full]
        needed[width] += len(again)
    else:
        again = open_
    keep = min(b, width)
    out = np.empty((n, b), np.uint8)
    wide = np.full((n, b + 1), np.inf)
    out[:, :keep], wide[:, :keep] = order[:, :keep], bounds[:, :keep]
    # Entries that are no longer listed fall under the outer bound.
    wide[:, b] = bounds[:, keep:].min(axis=1)
    if b > width:  # a wider list has to be made anew
        again = np.arange(n)
    if len(again):
        new = fresh(points[again], book, b)
        out[again], wide[again] = new.order, new.bounds
    return Lists(out, wide), needed


def next_width(width: int, needed: list[int], k: int) -> int:
    """``b`` for the next round: deep enough for all but one part in a hundred
    of those that did not need every entry, between k / 8 and k / 2; one in
    ten that needed every entry doubles it."""
    low, high = max(2, k // 8), max(2, k // 2)
    total = sum(needed)
    if total and needed[-1] * 10 > total:
        return min(2 * width, high, k)
    deep, seen = 0, 0
    for deep, n in enumerate(needed[:-1]):
        seen += n
        if seen * 100 >= 99 * (total - needed[-1]):
            break
    return min(max(deep + 1, low), width, k)


def _pack(lists: list[Lists]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x.order for x in lists], axis=1), np.concatenate([x.bounds for x in lists], axis=1)


def _unpack(order: np.ndarray, bounds: np.ndarray, widths: list[int]) -> list[Lists]:
    out, at = [], 0
    for p, b in enumerate(widths):
        out.append(Lists(order[:, at:at + b], bounds[:, at + p:at + p + b + 1]))
        at += b
    return out


_STATE = ("id {id}, label {label}, ints binary, nearest binary, bounds binary, "
          "part int, entry int, n long, sums array<long>, needed array<long>")


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray, old: list[int] | None, new: list[int],
           name: str) -> tuple[DataFrame, DataFrame, str]:
    """One pass: (rows with their new state, sums per task, folder)."""
    spark = rows.sparkSession
    n_parts, k, width = books.shape
    kinds = dict(rows.dtypes)
    schema = _STATE.format(id=kinds["id"], label=kinds["label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, k, width), np.int64)
        counts = np.zeros((n_parts, k), np.int64)
        needed = np.zeros((n_parts, 32 + k), np.int64)
        target = None
        for batch in batches:
            target = batch.schema if target is None else target
            m = len(batch)
            if not m:
                continue
            points = _rows(batch["ints"], "<i4").astype(np.int64).reshape(m, n_parts, width)
            if old is None:
                lists = [fresh(points[:, p], books[p], new[p]) for p in range(n_parts)]
            else:
                kept = _unpack(_rows(batch["nearest"], np.uint8), _rows(batch["bounds"], np.float64), old)
                lists = []
                for p in range(n_parts):
                    one, deep = advance(points[:, p], books[p], moved[p], kept[p], new[p])
                    needed[p, :len(deep)] += deep
                    lists.append(one)
            for p, one in enumerate(lists):
                first = one.order[:, 0].astype(np.int64)
                counts[p] += np.bincount(first, minlength=k)
                np.add.at(sums[p], first, points[:, p])
            order, bounds = _pack(lists)
            nothing = {"part": pa.nulls(m, pa.int32()), "entry": pa.nulls(m, pa.int32()), "n": pa.nulls(m, pa.int64()),
                       "sums": pa.nulls(m, pa.list_(pa.int64())), "needed": pa.nulls(m, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "label": batch["label"], "ints": batch["ints"],
                                              "nearest": _binary(order), "bounds": _binary(bounds), **nothing})
        if target is None:
            return
        at = [(p, e) for p in range(n_parts) for e in range(k)]
        m = len(at)
        yield pa.RecordBatch.from_pydict({
            "id": pa.nulls(m, target.field("id").type), "label": pa.nulls(m, target.field("label").type),
            **{c: pa.nulls(m, pa.binary()) for c in ("ints", "nearest", "bounds")},
            "part": pa.array([p for p, _ in at], pa.int32()), "entry": pa.array([e for _, e in at], pa.int32()),
            "n": pa.array([int(counts[p, e]) for p, e in at], pa.int64()),
            "sums": pa.array([sums[p, e].tolist() for p, e in at], pa.list_(pa.int64())),
            "needed": pa.array([needed[p].tolist() if e == 0 else None for p, e in at], pa.list_(pa.int64()))})

    path = fresh_folder(spark, name)
    (rows.mapInArrow(run, schema).withColumn("kind", F.when(F.col("part").isNull(), "rows").otherwise("sums"))
     .write.partitionBy("kind").parquet(path))
    both = spark.read.schema(schema + ", kind string").parquet(path)
    return (both.filter("kind = 'rows'").select("id", "label", "ints", "nearest", "bounds"),
            both.filter("kind = 'sums'").select("part", "entry", "n", "sums", "needed"), path)


def _moved_books(books: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The next codebooks, how far each entry moved, and the depths needed
    per part position.  One row per (part, entry) comes to the driver."""
    n_parts, k, width = books.shape
    out, needed = books.copy(), [[] for _ in range(n_parts)]
    totals = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    for r in totals.collect():
        if r["n"]:
            out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]  # floors go down
    depths = sums.filter("needed is not null").select("part", F.posexplode("needed").alias("depth", "n"))
    for r in depths.groupBy("part", "depth").agg(F.sum("n").alias("n")).orderBy("part", "depth").collect():
        needed[r["part"]].append(int(r["n"]))
    return out, np.sqrt(_square(out, books).astype(np.float64)), needed


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          n_parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code array<int>, error) per usable vector, and the codebooks
    (parts x entries x components).

    Each component x becomes floor(scale * x).  The codebooks start as the
    parts of the ``k`` smallest ids (fewer vectors: fewer entries; equal ids:
    by vector).  Each of ``rounds`` rounds assigns every part to its nearest
    entry (squared distance, ties to the lower index) and replaces each entry
    by its parts' componentwise floor of the mean; unused entries stay.  Then
    the parts are assigned once more.

    Rows whose vector is null, empty, holds a null or non-finite component or
    is of another length than the smallest id's vector are left out.  A length
    that is no multiple of ``n_parts``, or a scaled component beyond
    `LARGEST`, is an error.  Without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    lengths = (usable(vectors, vector_col).orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(1)
               .select(F.size(vector_col)).collect())
    dim = lengths[0][0] if lengths else n_parts
    if dim % n_parts:
        raise ValueError(f"{dim} components cannot be cut into {n_parts} equal parts")
    width = dim // n_parts
    rows, path = stage_at(scaled(vectors, id_col, vector_col, label_col, scale, dim), "vectors")
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(k).collect()  # k rows
    start = np.array([np.frombuffer(r["ints"], "<i4") for r in seeds], np.int64).reshape(len(seeds), n_parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    k = books.shape[1]
    if not k:
        return rows.select("id", "label", F.array().cast("array<int>").alias("code"),
                           F.lit(0).cast("long").alias("error")), books
    widths, old, moved = [min(k, max(2, k // 4))] * n_parts, None, np.zeros((n_parts, k))
    for n in range(rounds + 1):
        last = n == rounds
        new = widths if n < 2 else [next_width(w, d[:w + 1], k) for w, d in zip(old, needed)]
        state, sums, folder = _round(rows, books, moved, old, new, f"codes-{n}")
        unstage(spark, path)
        rows, path, old = state, folder, new
        if not last:
            books, moved, needed = _moved_books(books, sums)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum([0, *old[:-1]])
        for batch in batches:
            m = len(batch)
            points = (_rows(batch["ints"], "<i4") if m else np.empty(0)).astype(np.int64).reshape(m, n_parts, width)
            code = (_rows(batch["nearest"], np.uint8)[:, starts] if m else np.empty((0, n_parts))).astype(np.int32)
            error = sum((_square(points[:, p], books[p][code[:, p]]) for p in range(n_parts)), np.zeros(m, np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(list(code), pa.list_(pa.int32())),
                                              pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")
    out = stage(coded, "codes")
    unstage(spark, path)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows of a label, null labels together."""
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    keyed = coded.select("*", *key)
    return (keyed.join(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")), ["_none", "_label"])
            .drop("_none", "_label"))
