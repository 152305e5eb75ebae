"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Every code point gets a class, and with a look at its
neighbours a symbol of a small automaton; the automaton's transition functions are composed by an
associative scan (inside blocks side by side, then over the blocks), which gives the state before every code
point and so the places where a slice begins. Slices go through a bounded cache of merged slices; the misses
of a batch are merged together, the lowest-ranked pair of every slice at a time. The byte offset of each
slice stays with the ids, so any run of slices can be decoded alone.

Rows are independent: encoding and decoding are map-side only and run at the partitioning of the input.
Batches are cut into pieces of bounded bytes before anything is expanded.

Defined cases: null text is encoded as the empty text (no ids); texts of any length and without any space
work (a long slice is merged with a heap); repeated rows give repeated results; an empty table gives an
empty result; the columns in ``keep`` pass through, any other is ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
CACHE_SLICES = 200_000
BLOCK = 64
WIDTHS = (4, 8, 12, 16, 24, 48, 96)  # slices up to the last are merged side by side, longer ones with a heap
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]

# What the split pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ tells apart.
SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000]
SHORT_TAILS = "stmd"
LONG_TAILS = ("re", "ve", "ll")

# Symbols. An apostrophe counts as TAIL1 or TAIL2 if a contraction's one or two letters follow it. The last
# white space before anything else is GLUE (a blank, joins what follows) or LONE; the rest of it is RUN.
LETTER, NUMBER, OTHER, TAIL1, TAIL2, GLUE, LONE, RUN = range(8)
FIRST = 8  # added at the first code point of a document
# States: what the slice so far is. FRESH: the next code point begins a slice.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_GLUE, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, or GLUE for a blank and LONE for other white space."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[SPACES] = LONE
    out[0x20] = GLUE
    return out


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins), both indexed by state * 16 + symbol."""
    step, begins = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    body = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, TAIL1: IN_OTHERS, TAIL2: IN_OTHERS}
    for state in range(8):
        for symbol in range(8):
            if symbol == RUN:
                to, new = IN_RUN, state != IN_RUN
            elif symbol in (GLUE, LONE):
                to, new = (AFTER_GLUE if symbol == GLUE else FRESH), True
            elif symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
                to, new = (FRESH if state == ONE_LEFT else ONE_LEFT), False
            elif state in (AFTER_GLUE, body[symbol]):
                to, new = body[symbol], False
            else:
                to, new = {TAIL1: ONE_LEFT, TAIL2: TWO_LEFT}.get(symbol, body[symbol]), True
            step[state, symbol], begins[state, symbol] = to, new
    step[:, FIRST:], begins[:, FIRST:] = step[FRESH, :FIRST], True
    return step.ravel(), begins.ravel()


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbols of the documents' joined code points; ``first`` marks each document's first."""
    kind = classes()[points]
    follows = np.zeros(len(points), bool)  # another code point of the same document follows
    follows[:-1] = ~first[1:]
    blank = kind >= GLUE
    before_text = follows.copy()
    before_text[:-1] &= ~blank[1:]
    out = np.where(blank & ~before_text, np.uint8(RUN), kind)
    at = np.flatnonzero((points == 0x27) & follows)
    if len(at):
        one = points[at + 1]
        out[at[np.isin(one, [ord(c) for c in SHORT_TAILS])]] = TAIL1
        at2, one = at[follows[at + 1]], one[follows[at + 1]]
        two = points[at2 + 2]
        for a, b in LONG_TAILS:
            out[at2[(one == ord(a)) & (two == ord(b))]] = TAIL2
    out[first] += FIRST
    return out


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points that begin a slice.

    A symbol is a function from state to state, and composing functions is associative. Inside blocks of
    BLOCK symbols the functions are composed for all blocks at once; over the blocks by doubling; then every
    block runs again from its known first state.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    step, begins = automaton()
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, RUN, np.uint8)
    grid[:n] = symbols(points, first)
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    total = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        total = step[(total << 4) + column[:, None]]
    reach = 1
    while reach < rows:
        total[reach:] = np.take_along_axis(total[reach:], total[:-reach].copy(), 1)
        reach *= 2
    state = np.concatenate(([FRESH], total[:-1, FRESH])).astype(np.uint8)
    found = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(grid):
        index = (state << 4) + column
        found[j] = begins[index]
        state = step[index]
    return np.flatnonzero(found.T.ravel()[:n])


class Ranks:
    """A rank file: token bytes <-> ids, and every pair of tokens that joins to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.base = int(size)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.whole = {token: np.uint32(rank).tobytes() for token, rank in self.ids.items()}
        self.cache = dict(self.whole)

    def join_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair joins to, ``base`` for pairs that don't join; negative ids never join."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (b >= 0), self.joined[at], self.base)

    def merge_padded(self, slices: list[bytes], width: int) -> list[bytes]:
        """Ids of slices of at most ``width`` bytes, merged side by side."""
        lengths = np.array([len(s) for s in slices])
        parts = np.full((len(slices), width), -1, np.int64)
        parts[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(slices), np.uint8)]
        ranks = np.full(parts.shape, self.base, np.int64)
        if width > 1:
            ranks[:, :-1] = self.join_ranks(parts[:, :-1], parts[:, 1:])
        out = np.full(parts.shape, -1, np.int64)
        rows, columns = np.arange(len(slices)), np.arange(width)
        while len(rows):
            here = np.arange(len(rows))
            at = ranks.argmin(1)
            best = ranks[here, at]
            done = best == self.base
            if done.any():
                out[rows[done]] = parts[done]
                live = ~done
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            shifted = np.full(parts.shape, -1, np.int64)
            shifted[:, :-1] = parts[:, 1:]
            moved = np.full(ranks.shape, self.base, np.int64)
            moved[:, :-1] = ranks[:, 1:]
            later = columns[None, :] > at[:, None]
            parts, ranks = np.where(later, shifted, parts), np.where(later, moved, ranks)
            parts[here, at] = best
            after = np.minimum(at + 1, width - 1)
            ranks[here, at] = np.where(at + 1 < width, self.join_ranks(best, parts[here, after]), self.base)
            left = at > 0
            ranks[here[left], at[left] - 1] = self.join_ranks(parts[here[left], at[left] - 1], best[left])
        ids, counts = out.astype(np.uint32), (out >= 0).sum(1)
        return [row[:n].tobytes() for row, n in zip(ids, counts.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long slice: a heap of joinable neighbours over a linked list of parts."""
        parts = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs, base = len(parts), self.pairs, self.base
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (rank := pairs.get(parts[i] * base + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    joined = pairs.get(parts[k] * base + parts[after[k]])
                    if joined is not None:
                        heapq.heappush(heap, (joined, k, parts[k], parts[after[k]]))
        return np.array([p for p in parts if p >= 0], np.uint32).tobytes()

    def learn(self, slices: set[bytes]) -> None:
        """Put the ids of all ``slices`` into the cache, which is emptied first if it would get too large."""
        missing = slices - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE_SLICES + len(self.whole):
            self.cache = dict(self.whole)
            missing = slices - self.cache.keys()
        groups: dict[int, list[bytes]] = {}
        for s in missing:
            groups.setdefault(WIDTH_OF[len(s)] if len(s) <= WIDTHS[-1] else 0, []).append(s)
        for width, group in groups.items():
            merged = self.merge_padded(group, width) if width else map(self.merge_long, group)
            self.cache.update(zip(group, merged, strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """(ids as little-endian unsigned 32-bit integers, byte offsets of the slices likewise) per text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begin = (ends - lengths)[lengths > 0]
        first = np.zeros(len(points), bool)
        first[begin] = True
        starts = slice_starts(points, first)
        data = joined.encode()
        if len(data) == len(points):
            at, text_at = starts, ends - lengths
        else:
            size = np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000))
            size = np.concatenate(([0], size))
            at, text_at = size[starts], size[ends - lengths]
        cuts = [*at.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.learn(set(pieces))
        get = self.cache.__getitem__
        bounds = [*np.searchsorted(starts, ends - lengths).tolist(), len(pieces)]
        spans = list(zip(bounds, bounds[1:], strict=False))
        ids = [b"".join(map(get, pieces[a:b])) for a, b in spans]
        offsets = [(at[a:b] - t).astype(np.uint32).tobytes() for (a, b), t in zip(spans, text_at.tolist(), strict=True)]
        return ids, offsets

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, np.uint32).astype(np.int64)
        sizes = self.lengths[ids]
        at = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.offsets[ids] - at, sizes) + np.arange(int(sizes.sum()))].tobytes()


@lru_cache(2)
def ranks(path: str) -> Ranks:
    """One per Python worker."""
    return Ranks(path)


def in_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose ``column`` holds about ``most`` bytes, at least a row each."""
    values = batch.column(column)
    values = values.cast(pa.large_string() if pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
                         else pa.large_binary())
    sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1])
    chunk = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(values)] if len(values) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``ids`` and ``offsets``: packed little-endian unsigned 32-bit integers."""
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "__text"],
                           T.StructField("ids", T.BinaryType()), T.StructField("offsets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path)
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                ids, offsets = bpe.encode([t or "" for t in part.column("__text").to_pylist()])
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], [*keep, "ids", "offsets"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` plus ``decoded``, the bytes that the ids stand for."""
    kept = encoded.select(*[encoded[c] for c in keep], encoded[ids].alias("__ids"))
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "__ids"],
                           T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path)
        for batch in batches:
            for part in in_chunks(batch, "__ids"):
                decoded = [bpe.decode(x or b"") for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(decoded, pa.binary())], [*keep, "decoded"])

    return kept.mapInArrow(run, schema)
