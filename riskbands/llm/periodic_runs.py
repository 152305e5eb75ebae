"""Operator 12: periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least max(LEAST, REPEATS * q) long, that no neighbouring
word extends. Many documents are laid side by side, a word of its own kind between them, so one set of numpy
passes serves a whole chunk:

1. Words become whole numbers (equal words, equal numbers). Runs of periods below BASE are maximal stretches
   of words that equal the word q places on, one comparison for each such q.
2. At each dyadic scale t from BASE on, every window of t words has a hash (doubled from the scale before).
   Position i is synchronising when the least hash among the windows at i .. i + t stands at i or at i + t.
   Whether it is depends on the words i .. i + 2t - 1 only, so equal contexts choose alike. Windows that lie in
   a run of period at most t / REPEATS, found at a lower scale, take no part in the choice: there hashes repeat,
   and those periods are known already.
3. Each synchronising position is paired with the next one that has the same context of 2t words. A distance q in
   t .. 2t - 1 proposes period q. A run of such a period spans 4t words or more, holds a synchronising position
   within any t + 1 of its first ones, and the nearest equal context of that one lies exactly q on (a nearer one
   would give the run a smaller period, by Fine and Wilf). So every run is proposed, with its smallest period.
4. A proposal is compared word by word to both sides as far as period q reaches; long enough stretches are runs.

Hashes only propose; what is returned has been compared word by word.

Defined cases: null and empty texts have no runs and collapse to the empty text; a text of any length is taken
whole, alone in its chunk if need be; repeated rows and null ids give a row each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import words

LEAST = 6
REPEATS = 4
BASE = 8
CHUNK_BYTES = 1 << 20
STEP = 256  # words compared at once while a proposal is extended, doubled as long as they agree
_K = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]  # start, end (exclusive), period


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values: block-wise running minima from both sides."""
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, _TOP)
    padded[:len(h)] = h
    grid = padded.reshape(blocks, width)
    after = np.minimum.accumulate(grid, axis=1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(before[:n], after[width - 1:width - 1 + n])


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start on."""
    done, step = 0, STEP
    most = min(len(a), len(b))
    while done < most:
        until = min(done + step, most)
        same = a[done:until] == b[done:until]
        if not same.all():
            return done + int(np.argmin(same))
        done = until
        step *= 2
    return done


def stretch(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` in which words ``period`` apart are equal."""
    left = agreeing(ids[:at][::-1], ids[period:at + period][::-1])
    right = agreeing(ids[at:], ids[at + period:])
    return at - left, at + right + period


def small_periods(ids: np.ndarray) -> list[Run]:
    """Runs of periods below BASE; a stretch whose smaller period is known by the same ends is left out."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(BASE, len(ids))):
        edge = np.diff(np.concatenate(([0], (ids[q:] == ids[:-q]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = ends - starts >= max(LEAST, REPEATS * q)
        for ends_at in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            found.setdefault(ends_at, q)
    return [(a, b, q) for (a, b), q in found.items()]


def synchronising(h: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions at which the least window hash of i .. i + scale stands at either end."""
    chosen = np.where(periodic[:len(h)], _TOP, h)
    least = window_least(chosen, scale + 1)
    ends = (chosen[:len(least)] == least) | (chosen[scale:scale + len(least)] == least)
    return np.flatnonzero(ends & (least != _TOP))


def runs(ids: np.ndarray, longest: int | None = None) -> list[Run]:
    """All runs of a sequence of whole numbers, by start and period; ``longest`` bounds a part without runs across."""
    found = small_periods(ids)
    n, scale = len(ids), BASE
    h = mixed(ids.astype(np.uint64) + _K)
    width = 1
    while width < scale and n >= REPEATS * scale:
        h = mixed(h[:-width] * _K + h[width:])
        width *= 2
    while REPEATS * scale <= min(n, longest or n):
        # windows of this scale that start inside a run of a small period, far enough from its end
        cover = np.zeros(n + 1, np.int32)
        for a, b, q in found:
            if REPEATS * q <= scale <= b - a:
                cover[a] += 1
                cover[b - scale + 1] -= 1
        wide = mixed(h[:-scale] * _K + h[scale:])
        at = synchronising(h, scale, np.cumsum(cover)[:-1] > 0)
        at = at[at < len(wide)]
        order = at[np.argsort(wide[at], kind="stable")]
        near = np.flatnonzero(wide[order[1:]] == wide[order[:-1]])
        period = order[near + 1] - order[near]
        fits = (period >= scale) & (period < 2 * scale)
        here, period = order[near][fits], period[fits]
        turn = np.lexsort((here, period))
        last, until = 0, 0
        for i, q in zip(here[turn].tolist(), period[turn].tolist(), strict=True):
            if q == last and i + q < until:
                continue
            a, b = stretch(ids, i, q)
            last, until = q, b
            if b - a >= max(LEAST, REPEATS * q):
                found.append((a, b, q))
        h, scale = wide, 2 * scale
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text's words, the texts laid side by side."""
    numbers: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for k, found in enumerate(texts):
        part = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        parts += [part, np.array([-1 - k])]
        starts.append(at)
        at += len(found) + 1
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    found = runs(ids, max(map(len, texts), default=0))
    owner = np.searchsorted(np.array(starts), [r[0] for r in found], side="right") - 1
    for k, (a, b, q) in zip(owner.tolist(), found, strict=True):
        out[k].append((a - starts[k], b - starts[k], q))
    return out


def dropped(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    change = np.zeros(n + 1, np.int32)
    for a, b, q in found:
        change[a + q] += 1
        change[b] -= 1
    return np.cumsum(change)[:n] > 0


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period, of equal ones the first, then the one of the least period."""
    best = None
    for a, b, q in found:
        if best is None or (b - a) * best[2] > (best[1] - best[0]) * q:
            best = (a, b, q)
    return best


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Per document: doc_id, n_words, ``runs`` by start and period, the ``strongest`` one and the ``collapsed`` text.

    ``collapsed`` keeps the words that no run holds after its first period, joined by single spaces.
    """
    column = docs[text] if isinstance(text, str) else text
    kept = docs.select("doc_id", F.coalesce(column, F.lit("")).cast("binary").alias("__text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed binary"
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def row(r: Run) -> dict:
        return {"start": r[0], "length": r[1] - r[0], "period": r[2]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text", CHUNK_BYTES):
                texts = [t.split() for t in part.column("__text").to_pylist()]
                found = runs_of_texts(texts)
                collapsed = [b" ".join(w for w, gone in zip(t, dropped(len(t), f).tolist(), strict=True) if not gone)
                             if f else b" ".join(t) for t, f in zip(texts, found, strict=True)]
                best = [strongest(f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([[row(r) for r in f] for f in found], pa.list_(run_type)),
                     pa.array([None if r is None else row(r) for r in best], run_type),
                     pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return kept.mapInArrow(scan, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, repeats a stretch up to its end.

    With h = crc32(doc_id), g = h div 10 and n words: where h mod 10 is 0, word i >= a = g mod n becomes word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    due = h % 10 == 0
    d = docs.select("doc_id", "text", F.when(due, words(F.col("text"))).alias("__w"), F.floor(h / 10).alias("__g"))
    n = "size(__w)"
    d = d.withColumn("__a", F.expr(f"if({n} > 0, __g % {n}, 0)"))
    d = d.withColumn("__p", F.expr(f"1 + ({n} - __a) div (3 + __g % 8)"))
    turned = F.expr("array_join(transform(__w, (w, i) -> if(i < __a, w, __w[cast(__a + (i - __a) % __p as int)])), ' ')")
    return d.select("doc_id", F.when(F.expr(f"coalesce({n}, 0) > 0"), turned).otherwise(F.col("text")).alias("text"))
