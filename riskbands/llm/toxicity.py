"""Operator 10: toxicity by a support vector machine on a gap-weighted subsequence kernel.

The kernel of two terms sums over their common subsequences of ORDER characters, each weighted by
DECAY ** (its span in both), and is normalised: an insult with inserted, doubled or separated characters
keeps most of its kernel with the plain one. Terms are white-space words without outer punctuation, longer
ones in overlapping windows, and runs of single characters joined ("i d i o t"). The kernel counts only
where a term holds at least COVER of the landmark's code points, of whatever script; elsewhere it is 0. A
landmark of fewer than ORDER characters has the kernel of its own length's order.

Training sees sentences of labelled documents. A sentence is a bag of terms: in toxic documents its witness is
the term most associated with the label (sentences that documents share count once). All words that pass LEAST_G and LEAST_SHARE are positive and landmarks,
as are harmless ones like them (words only: combinations of words aren't terms); the
Nyström map K_mm ** -1/2 turns kernel values into features, on which a linear SVM separates witnesses from
the terms of harmless sentences; each witness also stands in variants with a character put in. A document's margin is that of its most toxic term, made a probability by a
sigmoid fitted to the training documents.

Fitting uses at most SAMPLE labelled documents of each class (those with the least hash of their id, texts up
to LONGEST code points): a fixed bound. Scoring is map-side over all terms of whole texts.

Defined cases: null or empty text scores as a text without any toxic term; ids of any value are hashed as
text (null as the empty string); without labelled toxic rows every text gets the share of toxic rows (0 if
there are no rows); repeated rows get equal scores; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks

ORDER, DECAY, COVER = 3, 0.8, 0.75
FOLLOW, REACH = 0.5, 3  # share of a landmark's neighbouring letters that a term holds in order, and how far apart
WINDOW = 24
SAMPLE, LONGEST = 1500, 20_000
HARMLESS, NEGATIVES, GRAM = 64, 8000, 4
ROWS = 4000  # terms whose kernel values are held at once
POWER = 2  # the kernel is the normalised subsequence kernel to this power
DISGUISED = 0.5  # weight of a witness's variants with a character put in
LEAST_G, LEAST_SHARE = 15.0, 0.6
CACHE_TERMS = 500_000
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")


_bare = methodcaller("strip", string.punctuation)


def windows(word: str) -> list[str]:
    """The kernel's terms of a word: itself without outer punctuation, long ones in halves that overlap."""
    term = word.strip(string.punctuation)
    if len(term) <= WINDOW:
        return [term] if term else []
    return [term[k:k + WINDOW] for k in range(0, len(term) - WINDOW // 2, WINDOW // 2)]


def spelled(words: list[str]) -> list[str]:
    """Words that runs of two or more single characters spell."""
    single = bytes(map((1).__eq__, map(len, words)))
    return ["".join(words[m.start():m.end()]) for m in re.finditer(b"\x01{2,}", single)]


def words_of(text: str | None) -> list[str]:
    found = (text or "").lower().split()
    return [*found, *spelled(found)]


def codes(terms: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    out = np.zeros((len(terms), max(1, sizes.max(initial=1))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(terms).encode("utf-32-le"), np.int32)
    return out


def alphabet_of(c: np.ndarray) -> np.ndarray:
    """The code points of a code matrix, ascending."""
    return np.unique(c[c > 0])


def letter_counts(c: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each row holds each code point of the alphabet."""
    size, slots = len(alphabet), letter_slots(c, alphabet)
    rows = np.arange(len(c))[:, None] * (size + 1)
    counts = np.bincount((rows + slots).ravel(), minlength=len(c) * (size + 1))
    return counts.reshape(len(c), size + 1)[:, :-1].astype(np.int8)


def letter_slots(c: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Each code point's place in the alphabet, its size for those that are not in it."""
    slots = np.searchsorted(alphabet, c)
    slots[(c == 0) | (alphabet[np.minimum(slots, len(alphabet) - 1)] != c)] = len(alphabet)
    return slots


class Neighbours:
    """Which pairs of neighbouring letters of the landmarks a term holds in order."""

    def __init__(self, c: np.ndarray, alphabet: np.ndarray):
        self.alphabet, self.side = alphabet, len(alphabet) + 1
        slots = letter_slots(c, alphabet)
        first, second = slots[:, :-1], slots[:, 1:]
        there = (first < len(alphabet)) & (second < len(alphabet))
        pairs = first * self.side + second
        known = np.unique(pairs[there])
        self.place = np.full(self.side * self.side, len(known))  # the last column is for all other pairs
        self.place[known] = np.arange(len(known))
        self.held = np.zeros((len(c), len(known) + 1), np.float32)
        rows = np.broadcast_to(np.arange(len(c))[:, None], pairs.shape)
        self.held[rows[there], self.place[pairs[there]]] = 1
        self.needed = FOLLOW * self.held.sum(1)

    def follow(self, c: np.ndarray) -> np.ndarray:
        """Whether each term (rows of a code matrix) holds enough pairs of each landmark."""
        slots = letter_slots(c, self.alphabet)
        found = np.zeros((len(c), self.held.shape[1]), np.float32)
        for gap in range(1, min(REACH, c.shape[1] - 1) + 1):
            pairs = self.place[slots[:, :-gap] * self.side + slots[:, gap:]]
            found[np.arange(len(c))[:, None], pairs] = 1
        found[:, -1] = 0
        return found @ self.held.T >= self.needed


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of letters, repeats counted, that each row of ``a`` shares with each row of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    for least in range(1, int(b.max(initial=0)) + 1):
        used = np.flatnonzero((b >= least).any(0))
        out += (a[:, used] >= least).astype(np.float32) @ (b[:, used] >= least).astype(np.float32).T
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Unnormalised kernel of the rows of two code matrices (0 pads), row by row.

    Rows go through in parts of like lengths, each without the padding that all its rows share.
    """
    out = np.zeros(len(a))
    sizes = (a != 0).sum(1), (b != 0).sum(1)
    order_of = np.lexsort(sizes)
    for at in range(0, len(a), 4096):
        rows = order_of[at:at + 4096]
        n, m = (int(s[rows].max()) for s in sizes)
        x, y = a[rows, :n].T, b[rows, :m].T
        match = ((x[:, None] == y[None]) & (x[:, None] != 0)).astype(np.float32)
        before = np.ones((n + 1, m + 1, x.shape[1]), np.float32)
        for _ in range(order - 1):
            now = np.zeros_like(before)
            for i in range(1, n + 1):
                run = np.zeros(x.shape[1], np.float32)
                for j in range(1, m + 1):
                    run = decay * (run + decay * match[i - 1, j - 1] * before[i - 1, j - 1])
                    now[i, j] = decay * now[i - 1, j] + run
            before = now
        out[rows] = decay ** 2 * (match * before[:-1, :-1]).sum((0, 1))
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel values with the landmarks: the SVM's weights through the Nyström map
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    margins: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.codes = codes(self.landmarks)
        self.alphabet = alphabet_of(self.codes)
        self.counts = letter_counts(self.codes, self.alphabet) if self.landmarks else None
        self.pairs = Neighbours(self.codes, self.alphabet) if self.landmarks else None
        self.lengths = np.array([len(t) for t in self.landmarks])
        self.orders = np.minimum(self.lengths, ORDER)
        self.own = np.ones(len(self.landmarks))
        for order in np.unique(self.orders):
            marks = np.flatnonzero(self.orders == order)
            self.own[marks] = subsequence_kernel(self.codes[marks], self.codes[marks], order)

    def __reduce__(self):
        return Model, (self.landmarks, self.weights, self.bias, self.slope, self.shift)

    def kernel(self, terms: list[str]) -> np.ndarray:
        """Normalised kernel of each term with each landmark."""
        out = np.zeros((len(terms), len(self.landmarks)))
        if not terms or not self.landmarks:
            return out
        c = codes(terms)
        held = common_letters(letter_counts(c, self.alphabet), self.counts)
        found, which = np.nonzero((held >= COVER * self.lengths) & self.pairs.follow(c))
        for order in np.unique(self.orders[which]):
            i, j = (x[self.orders[which] == order] for x in (found, which))
            rows, back = np.unique(i, return_inverse=True)
            own = subsequence_kernel(c[rows], c[rows], order)
            k = subsequence_kernel(c[i], self.codes[j], order)
            norm = np.sqrt(own[back] * self.own[j])
            out[i, j] = np.where(norm > 0, k / np.where(norm > 0, norm, 1), 0) ** POWER
        return out

    def margin(self, texts: Iterable[str | None]) -> np.ndarray:
        """Each text's largest margin of a term, ``bias`` (no likeness to any landmark) at least."""
        found = [words_of(t) for t in texts]
        unknown = list({w for ws in found for w in ws} - self.margins.keys())
        if len(self.margins) + len(unknown) > CACHE_TERMS:
            self.margins.clear()
            unknown = list({w for ws in found for w in ws})
        for at in range(0, len(unknown), ROWS):
            part = unknown[at:at + ROWS]
            terms = [t if len(t) <= WINDOW else windows(t) for t in map(_bare, part)]
            long = {w: t for w, t in zip(part, terms, strict=True) if isinstance(t, list)}
            flat = list({t for t in terms if isinstance(t, str)}.union(*long.values()) - {""})
            values = np.maximum(self.kernel(flat) @ self.weights + self.bias, self.bias)
            scores = {"": self.bias, **dict(zip(flat, values.tolist(), strict=True))}
            self.margins.update((w, scores[t]) for w, t in zip(part, terms, strict=True) if isinstance(t, str))
            self.margins.update((w, max(map(scores.__getitem__, ts), default=self.bias)) for w, ts in long.items())
        get = self.margins.__getitem__
        return np.array([max(map(get, ws), default=self.bias) for ws in found])

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.shift, -40, 40)))


def association(toxic: Counter, harmless: Counter, n: tuple[float, float], weight: tuple[float, float]
                ) -> dict[str, tuple[float, float]]:
    """Term -> (G statistic of its documents against the label, share of toxic ones among all rows' documents).

    ``n`` and ``weight`` are the sampled documents of class 0 and 1 and how many rows each of them stands for.
    """
    out = {}
    for t, a in toxic.items():
        b = harmless[t]
        share, base = a / (a + b), n[1] / (n[0] + n[1])
        if share > base:
            g = 2 * (a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0))
            out[t] = (g, a * weight[1] / (a * weight[1] + b * weight[0]))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) of a squared-hinge SVM by Newton steps on the rows inside the margin."""
    size = x.shape[1] + 1
    w, hold = np.zeros(size), ridge * np.eye(size)
    hold[-1, -1] = 1e-9
    for _ in range(25):
        inside = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        left, right = hold.copy(), np.zeros(size)
        for at in range(0, len(inside), ROWS):
            k = inside[at:at + ROWS]
            part = np.hstack([x[k], np.ones((len(k), 1))])
            rows = part * weight[k, None]
            left += rows.T @ part
            right += rows.T @ y[k]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def sigmoid(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of y = 1, by Newton steps with a slight prior."""
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * (w - [1.0, 0.0])), -2, 2)
    return float(w[0]), float(w[1])


def disguised(term: str) -> list[str]:
    """The term with a character put in between two others, or one doubled."""
    cuts = range(1, len(term))
    return [*[f"{term[:k]}.{term[k:]}" for k in cuts], *[term[:k] + term[k - 1:] for k in cuts]]


def grams(term: str, sizes: tuple[int, ...] = (GRAM,)) -> set[str]:
    return {term[k:k + n] for n in sizes for k in range(len(term) - n + 1)}


def fit(texts: list[str | None], labels: list[int], weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The model of documents with labels 0 and 1, each of which stands for ``weight[label]`` rows."""
    y = np.array(labels, float)
    stands = np.where(y > 0, weight[1], weight[0])
    base = float((y * stands).sum() / stands.sum()) if len(y) else 0.0
    constant = Model([], np.zeros(0), 0.0, 0.0, math.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    if not 0 < base < 1:
        return constant
    # a sentence that several documents of a class share counts in the first of them only: copies are no evidence
    bags, heard = [], {1: set(), 0: set()}
    counts = {1: Counter(), 0: Counter()}
    for text, label in zip(texts, labels, strict=True):
        sentences = [s for s in dict.fromkeys(SENTENCE.split(text or "")) if s not in heard[label]]
        heard[label].update(sentences)
        bags.append([{t for w in words_of(s) for t in windows(w)} for s in sentences])
        counts[label].update(set().union(*bags[-1]))
    linked = association(counts[1], counts[0], (len(y) - y.sum(), y.sum()), weight)
    ranked = sorted((t for t, (g, share) in linked.items() if g >= LEAST_G and share >= LEAST_SHARE),
                    key=lambda t: (-linked[t][0], t))
    if not ranked:
        return constant
    marked = set(ranked)
    sizes = tuple({GRAM, *(len(t) for t in ranked if len(t) < ORDER)})
    known = set().union(*(grams(t, sizes) for t in ranked))
    alike = sorted(((len(grams(t, sizes) & known), t) for t in counts[0].keys() - marked), key=lambda x: (-x[0], x[1]))
    plain = [t for _, t in alike[:NEGATIVES]]
    landmarks = ranked + sorted(plain[:20 * HARMLESS], key=lambda t: (-counts[0][t], t))[:HARMLESS]
    model = Model(landmarks, np.zeros(len(landmarks)), 0.0)
    witnesses = [max(s & marked, key=lambda t: (linked[t][0], t))
                 for bag, label in zip(bags, labels, strict=True) if label for s in bag if s & marked]
    gram = model.kernel(landmarks)
    power, basis = np.linalg.eigh((gram + gram.T) / 2)
    nystrom = basis @ np.diag(1 / np.sqrt(np.maximum(power, 1e-3))) @ basis.T
    seen = Counter(witnesses)
    toxic = [(t, 1.0 + seen[t]) for t in sorted(marked)]
    toxic += [(v, DISGUISED * n / len(vs)) for t, n in toxic if (vs := disguised(t)) for v in vs]
    terms = [*[t for t, _ in toxic], *plain]
    x = np.empty((len(terms), len(landmarks)))
    for at in range(0, len(terms), ROWS):
        x[at:at + ROWS] = model.kernel(terms[at:at + ROWS]) @ nystrom
    sign = np.concatenate([np.ones(len(toxic)), -np.ones(len(plain))])
    mass = np.array([*[n for _, n in toxic], *[1.0 + counts[0][t] for t in plain]])
    mass[:len(toxic)] /= mass[:len(toxic)].sum()
    mass[len(toxic):] /= max(1.0, mass[len(toxic):].sum())
    w = linear_svm(x, sign, mass)
    model.weights, model.bias = nystrom @ w[:-1], float(w[-1])
    model.slope, model.shift = sigmoid(model.margin(texts), y, stands)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit to at most ``most`` labelled documents of each class that aren't held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    known = known.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    totals = dict(known.groupBy("__toxic").count().collect())
    pick = F.xxhash64(F.col("__id"))
    chosen = [known.filter(F.col("__toxic") == c).orderBy(pick, "__id").limit(most) for c in (0, 1)]
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(
        chosen[0].unionByName(chosen[1]), F.col("doc_id") == F.col("__id")).orderBy("__id").collect()
    got = [[r["__toxic"] for r in rows].count(c) for c in (0, 1)]
    weight = tuple(totals.get(c, 0) / got[c] if got[c] else 0.0 for c in (0, 1))
    return fit([r.text for r in rows], [r["__toxic"] for r in rows], weight)


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``score`` (0 to 1) and ``predicted``."""
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "__text"],
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                score = model.score(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(score, pa.float64()),
                     pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return kept.mapInArrow(run, schema)
