"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its text exactly when every token
encodes to itself and every neighbouring pair is stable, that is, encoding
the pair's bytes gives the pair back.  So the merges compile into a
nondeterministic transducer over bytes whose state is (last finished token,
position in the token trie): it may finish a token wherever the trie has one
that is stable after the last.  The transducer is determinised while it runs:
a deterministic state is the set of positions alive after a prefix, and both
states and transitions are made when first needed and then looked up.

Each prefix has one encoding, so a transition yields one token: the last one
of the prefix.  Tokens are emitted as soon as all live positions agree on
them, a few tokens behind the input, so a piece of any length is encoded in
one pass and bounded memory.  Decoding streams the tokens' bytes through an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT, NOTHING = 0, 1 << 30
#: Bits of a token id and of a trie node where two numbers share an integer.
TOKEN, NODE = 20, 24
TOKEN_MASK, NODE_MASK = (1 << TOKEN) - 1, (1 << NODE) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file (base64 token, space, id per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes byte pieces; see the module's docstring.

    The tables that grow while it runs are bounded: a full one is emptied and
    filled again from where the input stands.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 1 << 18, max_pairs: int = 1 << 19):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.edges: dict[int, int] = {}  # trie node * 256 + byte -> node
        self.ends: list[int] = [NOTHING]  # token that ends at a trie node
        self.depth: list[int] = [0]
        for token, i in ranks.items():
            node = ROOT
            for b in token:
                to = self.edges.get(node << 8 | b)
                if to is None:
                    to = self.edges[node << 8 | b] = len(self.ends)
                    self.ends.append(NOTHING)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.ends[node] = i
        self.inner = bytearray(len(self.ends))  # trie nodes that a longer token goes through
        for edge in self.edges:
            self.inner[edge >> 8] = 1
        self.histories: dict[int, tuple[list[int], list[bytes], list[bytes]] | None] = {}
        self.stable: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A position alive: (last token + 1, or 0 at the start) and trie node.
        start = (ROOT,)
        self.states: list[tuple[int, ...]] = [start]
        self.numbers = {start: 0}
        self.steps: dict[int, int] = {}  # state * 256 + byte -> state and token

    def merge(self, piece: bytes) -> tuple[list[bytes], list[int], list[bytes], list[bytes]]:
        """The merges themselves, lowest rank first, leftmost among equals.

        Returns the final parts, the rank of each merge, and the first and
        the last part before each merge and at the end.
        """
        parts = [piece[i:i + 1] for i in range(len(piece))]
        done, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NOTHING), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NOTHING:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            done.append(rank)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return parts, [*done, NOTHING], firsts, lasts

    def _history(self, token: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """How the token's bytes merge; None if not into the token."""
        if token not in self.histories:
            parts, done, firsts, lasts = self.merge(self.tokens[token])
            self.histories[token] = (done, firsts, lasts) if len(parts) == 1 else None
        return self.histories[token]

    def _pair(self, last: int, token: int) -> bool:
        """Whether merging the two tokens' bytes leaves the two tokens.

        Both sides merge as they would alone, the lower rank first, until a
        merge across the border ranks below what either side does next.
        """
        left, right = self._history(last), self._history(token)
        if left is None or right is None:
            return False
        (a, _, ends), (b, starts, _), i, j = left, right, 0, 0
        while True:
            across = self.ranks.get(ends[i] + starts[j], NOTHING)
            if across < a[i] and across <= b[j]:
                return False
            if a[i] <= b[j]:
                if a[i] == NOTHING:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` is stable after the token ``last - 1`` (0: at the start)."""
        if not last:
            return self._history(token) is not None
        key = last << TOKEN | token
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= self.max_pairs:
                self.stable.clear()
            known = self.stable[key] = self._pair(last - 1, token)
        return known

    def _step(self, state: int, byte: int) -> int:
        alive, token = [], NOTHING
        for position in self.states[state]:
            to = self.edges.get((position & NODE_MASK) << 8 | byte)
            if to is None:
                continue
            last = position >> NODE
            if self.inner[to]:  # else no longer token can come of it
                alive.append(last << NODE | to)
            end = self.ends[to]
            if token == NOTHING and end != NOTHING and self.follows(last, end):
                token = end
        alive.append(token + 1 << NODE | ROOT)
        key = tuple(alive)
        number = self.numbers.get(key)
        if number is None:
            full = len(self.states) >= self.max_states
            if full:
                self._reset()
            number = self.numbers.setdefault(key, len(self.states))
            if number == len(self.states):
                self.states.append(key)
            if full:
                return number << TOKEN | token
        step = self.steps[state << 8 | byte] = number << TOKEN | token
        return step

    def _back(self, ends: list[int], base: int, at: int) -> list[int]:
        """Tokens from position ``base`` to ``at``, by the last token of each prefix."""
        out = []
        while at > base:
            token = ends[at - base - 1]
            out.append(token)
            at -= self.size[token]
        out.reverse()
        return out

    def run(self, piece: Iterable[int], window: int = 4096) -> Iterator[list[int]]:
        """Encode a stream of bytes; yields tokens once they are certain."""
        state, base, at, ends = 0, 0, 0, []
        for byte in piece:
            step = self.steps.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> TOKEN
            ends.append(step & TOKEN_MASK)
            at += 1
            if len(ends) >= window:
                # Follow all live starts back to where they meet.
                starts = {at - self.depth[position & NODE_MASK] for position in self.states[state]}
                while len(starts) > 1 and max(starts) > base:
                    last = max(starts)
                    starts.remove(last)
                    starts.add(last - self.size[ends[last - base - 1]])
                meet = max(min(starts), base)
                if meet > base:
                    yield self._back(ends, base, meet)
                    ends, base = ends[meet - base:], meet
        yield self._back(ends, base, at)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is a token stays whole
        if whole is not None:
            return [whole]
        if len(piece) > 4096:
            return [t for part in self.run(piece) for t in part]
        state, ends, steps = 0, [], self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
                steps = self.steps
            state = step >> TOKEN
            ends.append(step & TOKEN_MASK)
        return self._back(ends, 0, len(ends))


class Codec:
    """Text to ids, piece by piece.

    Ids of pieces are remembered as packed 32-bit integers in two generations:
    a full young one becomes the old one, and pieces of the old one that come
    again move to the young one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 1 << 18):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo = memo

    def _new(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.old.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= self.memo:
                self.old, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        get, new = self.known.get, self._new  # a generation that ends meanwhile stays right
        pieces = (self.pieces.findall(text) if len(text) < 1 << 20
                  else (m.group() for m in self.pieces.finditer(text)))
        return np.frombuffer(b"".join([get(p) or new(p) for p in pieces]), dtype=np.int32)


class Utf8Stream:
    """Incremental UTF-8 decoding.

    The state is the unfinished character at the end of what was fed: its
    lead byte says how many bytes it needs, and it waits until they are there.
    Ill-formed bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the character that ``data`` breaks off in, else 0."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:  # a lead byte
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self._unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_ids(tokens: list[bytes | None], ids: np.ndarray, chunk: int = 1 << 16) -> str:
    """Decode in chunks of ids; a character may span tokens and chunks."""
    utf8 = Utf8Stream()
    out = [utf8.feed(b"".join([tokens[i] for i in ids[at:at + chunk].tolist()])) for at in range(0, len(ids), chunk)]
    return "".join(out) + utf8.finish()


def vocabulary(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Token bytes by id."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


_CODECS: dict[tuple[int, int, str], Codec] = {}
_VOCABULARIES: dict[tuple[int, int, str], list[bytes | None]] = {}


def _codec(name: tuple[int, int, str], ranks: dict[bytes, int]) -> Codec:
    """The worker's codec; a worker keeps it from task to task."""
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, name[2])
    return _CODECS[name]


def _vocabulary(name: tuple[int, int, str], ranks: dict[bytes, int]) -> list[bytes | None]:
    if name not in _VOCABULARIES:
        _VOCABULARIES[name] = vocabulary(ranks)
    return _VOCABULARIES[name]


def _cuts(sizes: list[int], limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes each."""
    out, begin, held = [], 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= limit:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    return out if begin == len(sizes) else [*out, (begin, len(sizes))]


class Tokenizer:
    """Encodes and decodes columns.

    The ranks are read once on the driver and broadcast (a vocabulary has a
    fixed size); every Python worker compiles them once and keeps its states.
    Batches are taken apart by bytes, so a worker holds a few MB of results.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        self.shared = spark.sparkContext.broadcast(ranks)
        self.name = (len(ranks), hash(frozenset(ranks.items())), pattern)

    def encode(self, df: DataFrame, text_col: str, ids_col: str, keep: list[str],
               decoded_col: str | None = None) -> DataFrame:
        """``keep`` columns and ``ids_col`` (array<int>); null text has no ids.

        ``decoded_col`` adds the text decoded from the ids, in the same pass.
        """
        name, shared = self.name, self.shared
        inner = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(name, shared.value)
            tokens = _vocabulary(name, shared.value) if decoded_col else []
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
                for a, b in _cuts(sizes):
                    ids = [codec.encode(t or "") for t in texts.slice(a, b - a).to_pylist()]
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    made = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), type=pa.int32()))]
                    if decoded_col:
                        made.append(pa.array([decode_ids(tokens, x) for x in ids], type=pa.string()))
                    yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + made,
                                                     names=[f.name for f in fields])

        fields = [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        fields += [T.StructField("_ids", T.ArrayType(T.IntegerType()))]
        fields += [T.StructField("_text", T.StringType())] if decoded_col else []
        return inner.mapInArrow(run, T.StructType(fields)).toDF(*keep, ids_col, *([decoded_col] if decoded_col else []))

    def decode(self, df: DataFrame, ids_col: str, text_col: str, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``text_col``; null ids give the empty text."""
        name, shared = self.name, self.shared
        inner = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("_ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _vocabulary(name, shared.value)
            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                sizes = [n or 0 for n in pa.compute.list_value_length(lists).to_pylist()]
                for a, b in _cuts(sizes, 1 << 19):
                    texts = [decode_ids(tokens, x.values.to_numpy() if x.is_valid else np.empty(0, np.int32))
                             for x in lists.slice(a, b - a)]
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(texts, type=pa.string())],
                        names=[*batch.schema.names[:-1], "_text"])

        fields = [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        out = inner.mapInArrow(run, T.StructType([*fields, T.StructField("_text", T.StringType())]))
        return out.toDF(*keep, text_col)
