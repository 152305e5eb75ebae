"""Operator 11: quality scores learnt from preference pairs (Bradley-Terry).

Every text gets a fixed set of measures (repeated words, lines, sentences and word triples, symbols, capitals,
digits, lengths) in one map-side pass. A document of quality 1 is preferred to one of quality 0: the score is
linear in the measures and is fitted by the logistic loss on the differences of the measures of such pairs
(Newton steps with a ridge). Only differences matter, so the fit has no intercept; the threshold is a quantile of
the scores: the share of quality 0 among all labelled rows that may be learnt from, read from the counts, least
and greatest score of narrow score intervals over all those rows (a map-side aggregate). Where no row's score lies
between two groups, the threshold is half-way. A score maps to 0..1 with the threshold at CUT.

The fit uses at most SAMPLE labelled documents of each class (least hash of their id) and PAIRS partners for each
document of the rarer class: fixed bounds. Measuring, scoring and the threshold cover all rows and whole texts.

Defined cases: null and empty texts have all measures 0 and are scored by them; labels other than 0 and 1 and
labels without a document are ignored; where one class has no row to learn from, every text gets the share of
quality 1 (0.5 without any row); several labels of one document each count; repeated rows get equal scores; ids of
any value are hashed as text (null as the empty string); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import written

SAMPLE, PAIRS = 2000, 20
CUT = 0.3
RIDGE = 1e-3
STEPS = 4096  # score intervals of which the quantile is read

SYMBOLS, CAPITALS, DIGITS, CALLS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
STOPS, BRACKETS, HIGH = b".,;:", b"()[]{}/\\=_~^@", bytes(range(128, 256))
MEASURES = ("symbols", "capitals", "digits", "calls", "stops", "brackets", "high", "neighbours", "same_words",
            "same_triples", "same_lines", "same_sentences", "one_letter", "word_length", "line_words", "log_words")


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def repeated(found: list) -> float:
    return share(len(found) - len(set(found)), len(found))


def measures(text: bytes | None) -> list[float]:
    """The measures of a text, in the order of MEASURES: shares of its words, lines or bytes, and log lengths."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)

    def held(kind: bytes) -> int:
        return size - len(text.translate(None, kind))

    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    letters = sum(map(len, words))
    return [share(held(SYMBOLS), n), share(held(CAPITALS), letters), share(held(DIGITS), letters), share(held(CALLS), n),
            share(held(STOPS), n), share(held(BRACKETS), n), share(held(HIGH), letters),
            share(sum(map(operator.eq, words, words[1:])), n), repeated(words), repeated(triples), repeated(lines),
            repeated([x for x in text.split(b". ") if x.strip()]), share(sum(len(w) == 1 for w in words), n),
            math.log1p(share(letters, n)), math.log1p(share(n, len(lines))), math.log1p(n)]


def bent(x: np.ndarray) -> np.ndarray:
    """The measures and two bounded bends of each, so that small shares of a fault count as well as large ones."""
    return np.hstack([x, np.sqrt(np.minimum(x, 4.0)), np.minimum(x, 0.05) * 20])


@dataclass(frozen=True)
class Ranking:
    """A linear score of standardised measures; ``base`` is the constant score where nothing could be learnt."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    base: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (bent(x) - self.mean) / self.spread @ self.weights


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 11) -> Ranking:
    """The Bradley-Terry weights of measures of preferred and other texts."""
    good, bad = bent(good), bent(bad)
    both = np.vstack([good, bad])
    mean, spread = both.mean(0), both.std(0)
    spread[spread < 1e-9] = 1.0
    good, bad = (good - mean) / spread, (bad - mean) / spread
    rnd = np.random.default_rng(seed)
    fewer, more = min(len(good), len(bad)), max(len(good), len(bad))
    # each of the rarer class meets a turn of the other class's shuffled rows, so that those are used evenly
    turn = rnd.permutation(more)[np.arange(fewer * min(pairs, more)) % more]
    own = np.repeat(np.arange(fewer), min(pairs, more))
    d = good[turn] - bad[own] if len(good) >= len(bad) else good[own] - bad[turn]
    w = np.zeros(d.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ w)).mean() + ridge / 2 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = -(d * p[:, None]).mean(0) + ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step, now, size = np.linalg.solve(bend, slope), loss(w), 1.0
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return Ranking(mean, spread, w)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _mapped(docs: DataFrame, kind: T.DataType, per_part) -> DataFrame:
    """doc_id and ``value``, what ``per_part`` gives for a list of texts."""
    kept = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    schema = T.StructType([kept.schema["doc_id"], T.StructField("value", kind)])
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(per_part(part.column("__text").to_pylist()), arrow)], schema.names)

    return kept.mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """(__id, __label) of the rows that may be learnt from."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    return known.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, pairs: int = PAIRS) -> Ranking:
    """Fit to at most ``most`` labelled documents of each class that aren't held out."""
    known = learnable(labels)
    pick = F.xxhash64("__id")
    chosen = [known.filter(F.col("__label") == c).orderBy(pick, "__id").limit(most) for c in (0, 1)]
    # distinct ids: repeated labels shall not multiply the sample's documents
    chosen = written(chosen[0].unionByName(chosen[1]).distinct(), "preference-sample")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # repeated documents share the sample's bound
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))
    measured = _mapped(sample, T.ArrayType(T.DoubleType()), lambda texts: [measures(t) for t in texts])
    rows = measured.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).orderBy("__id", "__label").collect()
    x = [np.array([r.value for r in rows if r["__label"] == c]) for c in (0, 1)]
    if not len(x[0]) or not len(x[1]):
        totals = dict(known.groupBy("__label").count().collect())
        rows_known = sum(totals.values())
        return Ranking(np.zeros(0), np.zeros(0), np.zeros(0), totals.get(1, 0) / rows_known if rows_known else 0.5)
    return fit(x[1], x[0], pairs)


def quantile_of(scores: DataFrame, known: DataFrame, steps: int = STEPS) -> tuple[float, float]:
    """The score that the share of label 0 among the labelled rows lies below, and the scores' spread there.

    Scores are squashed to 0..1 and counted in ``steps`` equal intervals, with the least and greatest of each. In
    the interval that the rank falls into, the threshold is read linearly between these two.
    """
    labelled = scores.join(known, F.col("doc_id") == F.col("__id"))
    place = F.least(F.lit(steps - 1), F.floor(steps / (1 + F.exp(-F.col("value") / 4)))).cast("int")
    bins = labelled.groupBy(place.alias("place")).agg(
        F.count("*").alias("n"), F.sum((F.col("__label") == 0).cast("long")).alias("bad"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum("value").alias("sum"), F.sum(F.col("value") ** 2).alias("squares"))
    rows = sorted(bins.collect(), key=lambda r: r.place)
    n, rank = sum(r.n for r in rows), sum(r.bad for r in rows)
    spread = math.sqrt(max(sum(r.squares for r in rows) / n - (sum(r.sum for r in rows) / n) ** 2, 1e-6))
    passed = 0
    for k, r in enumerate(rows):
        if passed + r.n == rank and k + 1 < len(rows):
            return (r.hi + rows[k + 1].lo) / 2, spread
        if passed + r.n >= rank:
            return r.lo + (r.hi - r.lo) * (rank - passed) / r.n, spread
        passed += r.n
    return rows[-1].hi, spread


def quality_scores(docs: DataFrame, labels: DataFrame, model: Ranking | None = None, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, ``strength`` (the pairwise score), ``score`` and ``predicted`` (1 from the threshold on)."""
    model = model or train(docs, labels)
    if model.base is not None:
        base = F.lit(model.base)
        return docs.select("doc_id", F.lit(0.0).alias("strength"), base.alias("score"), (base >= cut).cast("int").alias("predicted"))
    strengths = _mapped(docs, T.DoubleType(), lambda texts: model.scores(np.array([measures(t) for t in texts])))
    strengths = written(strengths, "preference-scores")
    threshold, spread = quantile_of(strengths, learnable(labels))
    # the logistic curve passes CUT at the threshold
    shift = math.log(cut / (1 - cut))
    strength = F.col("value")
    score = 1 / (1 + F.exp(-((strength - F.lit(threshold)) * (4 / spread) + F.lit(shift))))
    above = strength >= F.lit(threshold)
    score = F.when(above, F.greatest(score, F.lit(cut))).otherwise(F.least(score, F.lit(cut - 1e-9)))
    return strengths.select("doc_id", strength.alias("strength"), score.alias("score"), above.cast("int").alias("predicted"))
