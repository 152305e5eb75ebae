"""Operator 6: personal data by a semi-Markov conditional random field.

Rules give the base spans (e-mail, IP, card, phone). A semi-Markov CRF then scores whole candidate segments
with features of the entire span (digits in it, separators, check sum, neighbours), and a dynamic program over
segments of at most MAX_TOKENS tokens chooses boundaries and kinds of a region jointly. Its spans are added
where they touch no base span; base spans always stay.

The model is trained here: windows around digits and at-signs of at most TRAIN_WINDOWS regions (those whose
hash is least, a fixed bound of a few hundred short strings) with the rules' spans as labels. The check
features (check sum, parts up to 255, complete address) are hidden for half of the training windows, so that
the segment's shape carries weight too. Scanning is map-side over whole texts; nothing is shuffled.

Defined cases: a null text has no spans; offsets are code points, ends exclusive; a long text without any
digit or at-sign costs one search; every scan is linear in the text, the segment search linear in a region's
tokens, of which it holds a bounded number of segments at a time (a table of numbers is one region); repeated rows get equal spans; an empty table trains a model that adds nothing; ``redact`` keeps all
columns of its input, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
TRAIN_WINDOWS = 240
EPOCHS = 6
REACH = 24  # code points of context around a digit or at-sign
LONGEST_TRAINED = 300

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
NUMERALS = "0123456789"

Span = tuple[int, int, int]  # start, kind's index, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The rules' spans, leftmost and without overlap within a kind."""
    out: list[Span] = []
    if not TRIGGER.search(text):
        return out
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for chain in DOTTED.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k:k + 4])) + 3
            if all(map(_small, parts[k:k + 4])):
                out.append((start, 1, start + size))
            start += size + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            only = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(only) <= 19 and luhn(only):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in NUMERALS for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, REACH code points wide to both sides, merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def _side(c: str) -> int:
    if not c or c.isspace():
        return 0
    return 1 if c.isalpha() else 2 if c in NUMERALS else 3


# Sizes of the feature groups: those of whole spans, then those of a single outside token.
SPAN_SIZES = (9, 3, 5, 3, 5, 3, 5, 2, 2, 2, 2, 2, 2, 4, 4, 6, 1)
SPAN_FROM = np.concatenate(([0], np.cumsum(SPAN_SIZES)[:-1]))
CHECKS = (10, 11, 12)
TOKEN_SIZE = 12
N_FEATURES = sum(SPAN_SIZES) + TOKEN_SIZE


def span_features(s: str, before: str, after: str, tokens: int) -> list[int]:
    digits = sum(c in NUMERALS for c in s)
    letters = sum(c.isalpha() for c in s)
    first, last = s[0], s[-1]
    only = "".join(c for c in s if c in NUMERALS) if 12 <= digits <= 19 else ""
    parts = s.split(".")
    return [
        _bucket(digits, 1, 4, 7, 9, 12, 16, 17, 20), min(s.count("@"), 2), min(s.count("."), 4),
        0 if not letters else 2 if letters == len(s) else 1,
        0 if first.isalpha() else 1 if first in NUMERALS else 2 if first == "+" else 3 if first == "(" else 4,
        0 if last.isalpha() else 1 if last in NUMERALS else 2,
        min(sum(c.isspace() for c in s), 4), int("-" in s), int("(" in s or ")" in s),
        int(any(not (c.isalnum() or c in " ._%+-@()") for c in s)),
        int(bool(only) and luhn(only) and len(only) + s.count(" ") + s.count("-") == len(s)),
        int(len(parts) == 4 and all(p and p.isascii() and p.isdigit() and _small(p) for p in parts)),
        int(s.count("@") == 1 and s[0] != "@" and bool(DOMAIN.fullmatch(s, s.index("@") + 1))),
        _side(before), _side(after), _bucket(tokens, 2, 4, 7, 10, 13), 0]


def token_feature(t: str) -> int:
    if t.isalpha():
        return 0
    if t[0] in NUMERALS:
        return 1 + _bucket(len(t), 2, 4, 12)
    return 5 + ("@.+-() ".find(t) if t in "@.+-()" else 6)


class Lattice:
    """A region's tokens and its candidate segments, with their features."""

    def __init__(self, text: str, start: int, end: int):
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
        self.n, self.found = len(found), found
        names = [text[a:b] for a, b in found]
        holds = np.concatenate(([0], np.cumsum([bool(TRIGGER.match(t)) for t in names])))
        self.tokens = np.array([token_feature(t) for t in names]) + sum(SPAN_SIZES)
        segments, rows = [], []
        for i in range(self.n):
            if names[i].isspace():
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if holds[j] == holds[i] or names[j - 1].isspace():
                    continue
                a, b = found[i][0], found[j - 1][1]
                segments.append((i, j))
                rows.append(span_features(text[a:b], text[a - 1:a], text[b:b + 1], j - i))
        self.segments = segments
        self.rows = np.array(rows, int).reshape(-1, len(SPAN_SIZES)) + SPAN_FROM
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(segments):
            self.ending[j].append(k)

    def scores(self, w: np.ndarray, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment for each kind, and of each token outside; ``shown`` masks feature groups."""
        return (w[1:, self.rows] * shown).sum(2).T, w[0, self.tokens]

    def best(self, w: np.ndarray, move: np.ndarray) -> list[Span]:
        """The best segmentation's spans. Ties go to outside tokens."""
        spans, outside = self.scores(w, np.ones(len(SPAN_SIZES)))
        top = np.full((self.n + 1, len(KINDS) + 1), -np.inf)
        top[0, 0] = 0
        back: list[list[tuple[int, int] | None]] = [[None] * (len(KINDS) + 1) for _ in range(self.n + 1)]
        for j in range(1, self.n + 1):
            reach = top[j - 1] + move[:, 0]
            y = int(reach.argmax())
            top[j, 0], back[j][0] = reach[y] + outside[j - 1], (j - 1, y)
            for k in self.ending[j]:
                i = self.segments[k][0]
                for kind in range(1, len(KINDS) + 1):
                    reach = top[i] + move[:, kind]
                    y = int(reach.argmax())
                    if reach[y] + spans[k, kind - 1] > top[j, kind]:
                        top[j, kind], back[j][kind] = reach[y] + spans[k, kind - 1], (i, y)
        out, j, y = [], self.n, int(top[self.n].argmax())
        while j > 0:
            i, before = back[j][y]
            if y:
                out.append((self.found[i][0], y - 1, self.found[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def gradient(self, gold: set[tuple[int, int, int]], w: np.ndarray, move: np.ndarray,
                 shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the segmentation whose entities are ``gold`` (i, j, kind from 1)."""
        spans, outside = self.scores(w, shown)
        kinds = len(KINDS) + 1
        forward = np.full((self.n + 1, kinds), -np.inf)
        entered = np.full((self.n + 1, kinds), -np.inf)
        forward[0, 0] = 0
        for j in range(self.n + 1):
            if j:
                forward[j, 0] = entered[j - 1, 0] + outside[j - 1]
                if ks := self.ending[j]:
                    into = np.array([entered[self.segments[k][0], 1:] for k in ks]) + spans[ks]
                    forward[j, 1:] = np.logaddexp.reduce(into, 0)
            entered[j] = np.logaddexp.reduce(forward[j][:, None] + move, 0)
        backward = np.full((self.n + 1, kinds), -np.inf)
        leave = np.full((self.n + 1, kinds), -np.inf)  # by the kind that begins here
        backward[self.n] = 0
        starting: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starting[i].append(k)
        for i in range(self.n - 1, -1, -1):
            leave[i, 0] = outside[i] + backward[i + 1, 0]
            if ks := starting[i]:
                onward = np.array([backward[self.segments[k][1], 1:] for k in ks]) + spans[ks]
                leave[i, 1:] = np.logaddexp.reduce(onward, 0)
            backward[i] = np.logaddexp.reduce(move + leave[i], 1)
        whole = np.logaddexp.reduce(forward[self.n])
        gw, gm = np.zeros_like(w), np.zeros_like(move)
        inside, at, y = np.zeros(self.n, bool), 0, 0
        kind_at = {i: (j, kind) for i, j, kind in gold}
        while at < self.n:
            j, kind = kind_at.get(at, (at + 1, 0))
            gm[y, kind] += 1
            inside[at:j] = kind > 0
            at, y = j, kind
        np.add.at(gw[0], self.tokens[~inside], 1)
        p = np.exp(entered[:-1, 0] + outside + backward[1:, 0] - whole)
        np.add.at(gw[0], self.tokens, -p)
        index = {s: k for k, s in enumerate(self.segments)}
        for i, j, kind in gold:
            np.add.at(gw[kind], self.rows[index[i, j]], shown)
        if self.segments:
            i, j = np.array(self.segments).T
            p = np.exp(entered[i, 1:] + spans + backward[j, 1:] - whole)
            for kind in range(1, kinds):
                np.add.at(gw[kind], self.rows, -p[:, kind - 1:kind] * shown)
        for i in range(self.n):
            gm -= np.exp(forward[i][:, None] + move + leave[i] - whole)
        return gw, gm


BLOCK_TOKENS = 1024  # starts whose segments are held at once
_ALPHA, _NUMERAL, _AT, _DOT, _SPACE, _BLANK, _DASH, _PAREN, _ODD = range(9)
_DIGIT_EDGES, _TOKEN_EDGES = np.array([1, 4, 7, 9, 12, 16, 17, 20]), np.array([2, 4, 7, 10, 13])


def _classes(s: str) -> np.ndarray:
    """Of each code point, whether it is in each of the nine classes that features count."""
    points, place = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    rows = [(c.isalpha(), c in NUMERALS, c == "@", c == ".", c.isspace(), c == " ", c == "-", c in "()",
             not (c.isalnum() or c in " ._%+-@()")) for c in map(chr, points.tolist())]
    return np.array(rows, bool).reshape(-1, 9)[place]


def _segment_rows(text: str, tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The features (as :func:`span_features`) of the segments of ``size`` tokens from each token in ``first``."""
    a, b = tokens[first, 0], tokens[first + size - 1, 1]
    lo, hi = int(a.min()) - 1, int(b.max()) + 1
    kind = _classes(text[max(lo, 0):hi])
    edge = np.zeros((1, 9), bool)
    kind = np.concatenate([*([edge] if lo < 0 else []), kind, *([edge] if hi > len(text) else [])])
    upto = np.concatenate([np.zeros((1, 9), np.int32), np.cumsum(kind, 0, dtype=np.int32)])
    held = upto[b - lo] - upto[a - lo]
    length = b - a
    digits, letters = held[:, _NUMERAL], held[:, _ALPHA]
    begin, last = kind[a - lo], kind[b - lo - 1]

    def side(at: np.ndarray) -> np.ndarray:
        # beyond the text there is no character of any class, which counts as white space
        beyond = (at < 0) | (at >= len(text))
        k = kind[at - lo]
        return np.where(beyond | k[:, _SPACE], 0, np.where(k[:, _ALPHA], 1, np.where(k[:, _NUMERAL], 2, 3)))

    out = np.zeros((len(a), len(SPAN_SIZES)), np.int64)
    out[:, 0] = np.searchsorted(_DIGIT_EDGES, digits, side="right")
    out[:, 1] = np.minimum(held[:, _AT], 2)
    out[:, 2] = np.minimum(held[:, _DOT], 4)
    out[:, 3] = np.where(letters == 0, 0, np.where(letters == length, 2, 1))
    out[:, 4] = np.where(begin[:, _ALPHA], 0, np.where(begin[:, _NUMERAL], 1, 4))
    for k in np.flatnonzero(out[:, 4] == 4).tolist():
        out[k, 4] = {"+": 2, "(": 3}.get(text[a[k]], 4)
    out[:, 5] = np.where(last[:, _ALPHA], 0, np.where(last[:, _NUMERAL], 1, 2))
    out[:, 6] = np.minimum(held[:, _SPACE], 4)
    out[:, 7], out[:, 8], out[:, 9] = held[:, _DASH] > 0, held[:, _PAREN] > 0, held[:, _ODD] > 0
    for k in np.flatnonzero((digits >= 12) & (digits <= 19) & (digits + held[:, _BLANK] + held[:, _DASH] == length)).tolist():
        out[k, 10] = luhn(text[a[k]:b[k]].replace(" ", "").replace("-", ""))
    for k in np.flatnonzero((held[:, _DOT] == 3) & (digits + 3 == length)).tolist():
        out[k, 11] = all(p and _small(p) for p in text[a[k]:b[k]].split("."))
    for k in np.flatnonzero((held[:, _AT] == 1) & ~begin[:, _AT]).tolist():
        s = text[a[k]:b[k]]
        out[k, 12] = bool(DOMAIN.fullmatch(s, s.index("@") + 1))
    out[:, 13], out[:, 14] = side(a - 1), side(b)
    out[:, 15] = np.searchsorted(_TOKEN_EDGES, size, side="right")
    return out


def best_spans(text: str, start: int, end: int, w: np.ndarray, move: np.ndarray) -> list[Span]:
    """The spans of the region's best segmentation, as :meth:`Lattice.best`, for regions of any length.

    The dynamic program runs from left to right and looks MAX_TOKENS ahead, so the segments of BLOCK_TOKENS starts are
    made, scored and dropped at a time; what stays is, for each token and kind, where the best segment that ends there
    begins (a few dozen bytes).
    """
    tokens = np.fromiter((x for m in TOKEN.finditer(text, start, end) for x in m.span()), np.int64).reshape(-1, 2)
    n, kinds = len(tokens), len(KINDS) + 1
    top = np.full((n + 1, kinds), -np.inf)
    top[0, 0] = 0
    begins = np.zeros((n + 1, kinds), np.int32)
    came = np.zeros((n + 1, kinds), np.int8)  # the best kind before one that begins here
    sizes = np.arange(1, MAX_TOKENS + 1)
    for at in range(0, n, BLOCK_TOKENS):
        names = [text[a:b] for a, b in tokens[at:at + BLOCK_TOKENS + MAX_TOKENS].tolist()]
        here = min(BLOCK_TOKENS, n - at)
        blank = np.fromiter(map(str.isspace, names), bool, len(names))
        holds = np.concatenate(([0], np.cumsum([bool(TRIGGER.match(t)) for t in names])))
        outside = w[0, np.array([token_feature(t) for t in names[:here]]) + sum(SPAN_SIZES)]
        i = np.arange(here)[:, None]
        j = np.minimum(i + sizes, len(names))
        good = (i + sizes <= len(names)) & ~blank[i] & ~blank[j - 1] & (holds[j] != holds[i])
        first, size = np.nonzero(good)
        score = np.full((here, MAX_TOKENS, kinds - 1), -np.inf)
        if len(first):
            rows = _segment_rows(text, tokens, first + at, size + 1) + SPAN_FROM
            score[first, size] = w[1:, rows].sum(2).T
        some = good.any(1).tolist()
        for k in range(here):
            now = at + k
            reach = top[now][:, None] + move
            y = reach.argmax(0)
            came[now] = y
            enter = reach[y, np.arange(kinds)]
            if enter[0] + outside[k] > top[now + 1, 0]:
                top[now + 1, 0], begins[now + 1, 0] = enter[0] + outside[k], now
            if some[k]:
                far = min(MAX_TOKENS, n - now)
                new, old = enter[1:] + score[k, :far], top[now + 1:now + 1 + far, 1:]
                better = new > old
                old[better] = new[better]
                begins[now + 1:now + 1 + far, 1:][better] = now
    out, j, y = [], n, int(top[n].argmax())
    while j > 0:
        i = int(begins[j, y])
        if y:
            out.append((int(tokens[i, 0]), y - 1, int(tokens[j - 1, 1])))
        j, y = i, int(came[i, y])
    return out[::-1]


def train(windows: list[str], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights per kind and feature, moves between kinds) by gradient steps on the windows' likelihood."""
    kinds = len(KINDS) + 1
    w, move = np.zeros((kinds, N_FEATURES)), np.zeros((kinds, kinds))
    w[1:, sum(SPAN_SIZES) - 1] = -2.0  # without any evidence nothing is an entity
    cases = []
    for text in windows:
        lattice = Lattice(text, 0, len(text))
        firsts = {a: k for k, (a, _) in enumerate(lattice.found)}
        lasts = {b: k + 1 for k, (_, b) in enumerate(lattice.found)}
        gold, free, known = set(), 0, set(lattice.segments)
        for a, kind, b in base_spans(text):
            if a >= free and a in firsts and b in lasts and (firsts[a], lasts[b]) in known:
                gold.add((firsts[a], lasts[b], kind + 1))
                free = b
        cases.append((lattice, gold))
    random, square_w, square_m = np.random.default_rng(7), np.full(w.shape, 1e-3), np.full(move.shape, 1e-3)
    for _ in range(epochs):
        for k in random.permutation(len(cases)):
            shown = np.ones(len(SPAN_SIZES))
            if random.random() < 0.5:
                shown[list(CHECKS)] = 0
            gw, gm = cases[k][0].gradient(cases[k][1], w, move, shown)
            gw, gm = gw - 1e-3 * w, gm - 1e-3 * move
            square_w += gw * gw
            square_m += gm * gm
            w += 0.3 * gw / np.sqrt(square_w)
            move += 0.3 * gm / np.sqrt(square_m)
    return w, move


def training_windows(docs: DataFrame, text: str = "text", most: int = TRAIN_WINDOWS) -> list[str]:
    """At most ``most`` regions of at most LONGEST_TRAINED code points: those whose hash is least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                found = {t[a:b] for t in part.column("__text").to_pylist() if t for a, b in regions(t)
                         if b - a <= LONGEST_TRAINED}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    rows = docs.select(docs[text].alias("__text")).mapInArrow(run, "w string").distinct()
    return [r.w for r in rows.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def all_spans(text: str, w: np.ndarray, move: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, base and model spans) by start, then kind."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    added = [s for a, b in regions(text) for s in best_spans(text, a, b, w, move)]
    if base:
        # the base spans' covered stretches, merged: a span that touches none of them is added
        starts = [x[0] for x in base]
        ends = list(accumulate((x[2] for x in base), max))
        added = [s for s in added if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]
    return base, sorted([*base, *added])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``base`` and ``spans``: lists of kind:start:end, comma-joined."""
    w, move = model if model is not None else train(training_windows(docs, text))
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "__text"],
                           T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                found = [all_spans(t or "", w, move) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array([listed(b) for b, _ in found], pa.string()),
                     pa.array([listed(s) for _, s in found], pa.string())], [*keep, "base", "spans"])

    return kept.mapInArrow(run, schema)


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """The documents with every span replaced; a column n_chars, if there is one, follows the new text."""
    w, move = model if model is not None else train(training_windows(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in in_chunks(batch, text):
                new = [t if t is None else redacted(t, all_spans(t, w, move)[1]) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
