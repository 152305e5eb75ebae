"""Operator 3: secret scans whose false positives a random forest removes.

Candidates are runs of at least 16 key-like characters that hold a digit, mix cases or stand behind an assignment,
and every value assigned to a name with a key word, whatever its length and characters: a quoted one up to the
closing quote, another up to white space, without trailing commas, semicolons, quotes and brackets. Runs inside such
a value stay candidates of their own. Each gets features: length, character transitions (log-likelihood under the corpus' own letter bigrams, class
changes, entropy, shares of digits, hexadecimal digits and capitals), dictionary coverage (share of its
letters inside frequent corpus words), the path (depth, markers of tests and examples) and the neighbouring
words (key words, assignment, quotes, markers). A random forest trained on labelled findings scores them.

``train`` takes any table of labelled findings. Without one, ``label_findings`` labels those of the corpus: a
quoted high-entropy value without white space assigned to a key word is a secret (entropy as far as the length of a
short one allows), any other candidate isn't; the neighbour
features of half of these rows are blanked, so that the forest also learns what secrets look like alone.
Training uses at most SAMPLE findings of each label (least hash first), a fixed bound.

The bigram table (ALPHABET squared) and the dictionary (DICTIONARY words) are counted over all documents,
map-side first, and have fixed sizes. Scanning is map-side over whole texts.

Defined cases: null text has no candidates; a null path has depth 0 and no marker; offsets are code points,
ends exclusive; repeated rows give repeated findings; an empty table gives an empty result; if only one label
occurs there is no forest, and the label's rule itself gives the score.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import written

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"(?<![A-Za-z0-9])[a-z]{4,8}(?![A-Za-z0-9])")
KEY_WORDS = ("token", "secret", "password", "passwd", "key", "auth", "credential", "apikey", "bearer")
KEYED = re.compile(rf"(?:{'|'.join(KEY_WORDS)})[A-Za-z0-9_-]{{0,64}}\\?[\"']?\s{{0,16}}(?::=|=>|[:=])\s{{0,16}}"
                   r"(?:(?:bearer|basic)\s{1,16})?(\\?[\"'`])?", re.IGNORECASE)
NO_SPACE = re.compile(r"\S+")
MARKERS = re.compile(r"test|example|sample|mock|dummy|fixture|demo", re.IGNORECASE)
ASSIGNED = re.compile(r"([A-Za-z_]+)[\"']?\s*(?:[:=]|:=|=>)\s*([\"']?)$")
REACH = 48
SAMPLE = 3000
DICTIONARY = 4096
COUNTER = 200_000
ALPHABET = string.ascii_lowercase + string.digits
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
_CODE[[ord(c) for c in string.ascii_uppercase]] = range(26)
SIDE = len(ALPHABET) + 1
FEATURES = ("length", "transition", "changes", "entropy", "digits", "hex", "capitals", "coverage", "path_depth",
            "path_marker", "key_word", "assigned", "quoted", "marker", "neighbour_coverage")
NEIGHBOURS = tuple(FEATURES.index(f) for f in ("key_word", "assigned", "quoted", "marker", "neighbour_coverage"))


def corpus_model(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, frozenset[str]]:
    """(log probability of the next letter class after each, the most frequent words) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(SIDE * SIDE, np.int64), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()),
                                               pa.array(list(words.values()), pa.int64())], ["what", "n"])

        for batch in batches:
            for part in in_chunks(batch, "__text"):
                joined = "\n".join(t or "" for t in part.column("__text").to_pylist())
                codes = _CODE[np.frombuffer(joined.encode(), np.uint8)]
                pairs += np.bincount(codes[:-1] * SIDE + codes[1:], minlength=SIDE * SIDE)
                words.update(WORD.findall(joined))
                if len(words) > COUNTER:
                    yield out()
                    words.clear()
        yield out()
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([f"#{k}" for k in used], pa.string()),
                                          pa.array(pairs[used], pa.int64())], ["what", "n"])

    counts = docs.select(docs[text].alias("__text")).mapInArrow(run, "what string, n long")
    counts = written(counts.groupBy("what").agg(F.sum("n").alias("n")), "secret-counts")
    table = np.ones((SIDE, SIDE))
    for r in counts.filter("what LIKE '#%'").collect():  # at most SIDE squared rows
        table.flat[int(r.what[1:])] += r.n
    top = counts.filter("what NOT LIKE '#%'").orderBy(F.desc("n"), "what").limit(DICTIONARY).collect()
    return np.log(table / table.sum(1, keepdims=True)), frozenset(r.what for r in top)


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that lie inside dictionary words of at least four letters, longest first."""
    value, at, held = value.lower(), 0, 0
    letters = sum(c in string.ascii_lowercase for c in value)
    while at + 4 <= len(value):
        size = next((k for k in range(min(8, len(value) - at), 3, -1) if value[at:at + k] in words), 0)
        held += size
        at += size or 1
    return held / letters if letters else 0.0


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def features(value: str, before: str, after: str, path: str | None, log: np.ndarray, words: frozenset[str]) -> list[float]:
    n = len(value)
    codes = _CODE[np.frombuffer(value.encode(), np.uint8)]
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    m = ASSIGNED.search(before)
    name = m.group(1).lower() if m else ""
    context = f"{before} {after}"
    near = WORD.findall(context.lower())
    return [
        float(n), float(log[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        entropy(value), kinds.count(0) / n, sum(c in string.hexdigits for c in value) / n, kinds.count(2) / n,
        coverage(value, words), float((path or "").count("/")), float(bool(path and MARKERS.search(path))),
        float(any(k in (name or before.lower()[-24:]) for k in KEY_WORDS)), float(bool(m)),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before and after)),
        float(bool(MARKERS.search(context))), sum(w in words for w in near) / len(near) if near else 0.0]


def closing(text: str, quote: str, at: int) -> int:
    """Where the quote that is open at ``at`` closes, -1 if nowhere; a backslash guards an unescaped kind of quote."""
    end = text.find(quote, at)
    while end >= 0 and len(quote) == 1:
        guards = end
        while guards > at and text[guards - 1] == "\\":
            guards -= 1
        if (end - guards) % 2 == 0:
            break
        end = text.find(quote, end + 1)
    return end


def keyed(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values assigned to names with a key word."""
    for m in KEYED.finditer(text):
        a, quote = m.end(), m.group(1)
        b = closing(text, quote, a) if quote else -1
        if b < 0 and (run := NO_SPACE.match(text, a)):
            b = a + len(run.group().rstrip(",;\"'`)]}>\\"))
        if b > a:
            yield a, b


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, what stands before, what stands behind) of each candidate."""
    out = [(a, b, text[max(0, a - REACH):a], text[b:b + REACH]) for a, b in keyed(text)]
    spans = {(a, b) for a, b, *_ in out}
    for m in CANDIDATE.finditer(text):
        value, a, b = m.group(), m.start(), m.end()
        before = text[max(0, a - REACH):a]
        if (a, b) not in spans and (any(c.isdigit() for c in value) or (value[1:].lower() != value[1:] and value.upper() != value)
                or ASSIGNED.search(before)):
            out.append((a, b, before, text[b:b + REACH]))
    return sorted(out)


def findings(docs: DataFrame, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",),
             model: tuple[np.ndarray, frozenset[str]] | None = None) -> DataFrame:
    """``keep``, start, end, value and ``x`` (the features) of every candidate."""
    log, words = model if model is not None else corpus_model(docs, text)
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"), docs[path].alias("__path"))
    own = [f for f in kept.schema.fields if not f.name.startswith("__")]
    schema = T.StructType([*own, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("value", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                rows, found = [], []
                for k, (t, p) in enumerate(zip(part.column("__text").to_pylist(), part.column("__path").to_pylist(),
                                               strict=True)):
                    for a, b, before, after in candidates(t or ""):
                        rows.append(k)
                        found.append((a, b, t[a:b], features(t[a:b], before, after, p, log, words)))
                index = pa.array(rows, pa.int64())
                a, b, values, x = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(index) for c in keep], pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(values, pa.string()), pa.array(x, pa.list_(pa.float64()))],
                    [*keep, "start", "end", "value", "x"])

    return kept.mapInArrow(run, schema)


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` plus ``label``: 1 for a quoted high-entropy value without white space assigned to a key word."""
    at = {f: F.col("x")[k] for k, f in enumerate(FEATURES)}
    high = F.least(F.lit(3.0), 0.75 * F.log2(at["length"]))  # under 3 for values of up to 15 characters
    secret = ((at["key_word"] + at["assigned"] + at["quoted"] == 3) & (at["entropy"] >= high) & (at["length"] >= 4)
              & (at["coverage"] < 0.5) & ~F.col("value").rlike(r"\s"))
    return found.withColumn("label", secret.cast("double"))


def train(labelled: DataFrame, most: int = SAMPLE, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from at most ``most`` findings of each label (``x``, ``label``); None unless both occur."""
    rows = labelled.select("label", "x", F.xxhash64("value", "x").alias("h"))
    parts = [rows.filter(F.col("label") == c).orderBy("h").limit(most) for c in (0.0, 1.0)]
    rows = parts[0].unionByName(parts[1])
    blank = F.transform("x", lambda v, i: F.when(i.isin(*NEIGHBOURS), F.lit(0.0)).otherwise(v))
    rows = rows.withColumn("x", F.when(F.pmod("h", F.lit(2)) == 0, blank).otherwise(F.col("x")))
    rows = written(rows.coalesce(1), "secret-training")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=24, maxDepth=6, seed=seed, featuresCol="v", labelCol="label")
    return forest.fit(rows.select("label", array_to_vector("x").alias("v")))


def scan(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", path: str = "source",
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, start, end, value, ``score`` (0 to 1) and ``secret`` of every candidate of the documents."""
    found = label_findings(written(findings(docs, text, path, keep), "secret-findings"))
    forest = train(found if labelled is None else labelled)
    if forest is None:
        scored = found.withColumn("score", F.col("label"))
    else:
        scored = forest.transform(found.withColumn("v", array_to_vector("x")))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(*keep, "start", "end", "value", "score", (F.col("score") >= 0.5).alias("secret"))
