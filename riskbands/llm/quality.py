"""Operator 9: quality rules with adaptive thresholds (DataFrame and SQL functions only).

Each text gets a few measures in one map-side pass. Per (language, source) a quantile sketch of every
measure is aggregated: the counts of its values in buckets, each GROWTH times as wide as the one below. Merging
two sketches adds counts, in whatever order, so the same documents give the same sketch however they are dealt
out, and retried tasks change nothing. A quantile read from it is at most GROWTH times the exact one and not below
it (values under LEAST count as 0). The language's sketches are the merge of its sources' sketches. The thresholds
are quartile fences (third quartile plus ``spread`` times the inter-quartile range), so they follow each group
instead of being fixed. The threshold table (one row per group) is written, reread
and joined back, and a document is rejected when a measure exceeds the fence of its group and that of its
language. A group with few documents therefore never rejects what is usual in its language, and a group of mostly
bad ones can't raise its limit above WIDEST times its language's fence.

Defined cases: a null text counts as an empty one (no words, fails the base rule); null language and null
source are groups of their own (null-safe join); repeated rows are judged alike and all returned; an empty
table gives an empty result; extra columns pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbands.llm.common import adjacent, words, written

#: Measure -> least spread that its fence assumes. Shares are per line, word or word character; a word's mean length is in code points.
MEASURES = {"symbol_share": 0.05, "upper_share": 0.05, "repeat_share": 0.10, "dup_line_share": 0.15,
            "word_length": 0.50}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPREAD = 3.0
LEAST, GROWTH = 1e-4, 1.01
WIDEST = 2.0


def measure(docs: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """``carry`` plus the counts of each text: words, word characters, symbols, repeated lines and words.

    ``n_repeat_words`` counts words inside any 3-word window that occurs at least twice: windows are hashed,
    sorted with their positions, and equal neighbours give the covered positions (n log n, no lookups).
    """
    d = docs.select(*carry, F.coalesce(text, F.lit("")).alias("__t"))
    keep = [c for c in d.columns if c != "__t"]
    d = d.select(*keep, "__t", words(F.col("__t")).alias("__w"),
                 F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    d = d.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "__w",
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    d = d.select(*keep, *counts, "__w", F.expr(adjacent("__w", "__w", 1, "xxhash64(a, b)")).alias("__p"))
    d = d.select(*keep, *counts, F.expr(adjacent("__p", "__w", 2, "xxhash64(a, b)")).alias("__g"))
    some = "size(array_distinct(__g)) < size(__g)"
    d = d.select(*keep, *counts,
                 F.expr(f"if({some}, sort_array(transform(__g, (x, i) -> struct(x, i))), "
                        "cast(array() as array<struct<x: bigint, i: int>>))").alias("__s"))
    pairs = adjacent("__s", "__s", 1, "if(a.x = b.x, array(a.i, b.i), cast(array() as array<int>))")
    d = d.select(*keep, *counts, F.expr(f"sort_array(array_distinct(flatten({pairs})))").alias("__r"))
    steps = adjacent("__r", "__r", 1, "least(3, b - a)")
    return d.select(*keep, *counts, F.expr(
        f"cast(if(size(__r) = 0, 0, 3 + aggregate({steps}, 0, (s, x) -> s + x)) as bigint)").alias("n_repeat_words"))


def _shares() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return {"symbol_share": share("n_symbols", "n_words"), "upper_share": share("n_upper", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "word_length": share("word_chars", "n_words")}


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value: 0 below LEAST, then one for each factor of GROWTH."""
    place = F.floor(F.ln(F.greatest(x, F.lit(LEAST)) / F.lit(LEAST)) / F.lit(math.log(GROWTH)) + 1e-9)
    return F.when(x < LEAST, F.lit(0)).otherwise(place + 1).cast("int")


def upper(b: Column) -> Column:
    """The value that a bucket stands for: its upper end, 0 for the first."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GROWTH), b))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, bucket, held): the sketch of each group and measure."""
    shares = measured.select(lang, source, *[bucket(c).alias(k) for k, c in _shares().items()])
    tall = ", ".join(f"'{k}', {k}" for k in MEASURES)
    tall = shares.select(lang, source, F.expr(f"stack({len(MEASURES)}, {tall}) AS (measure, bucket)"))
    return tall.groupBy(lang, source, "measure", "bucket").agg(F.count(F.lit(1)).alias("held"))


def quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """``group``, measure, q1 and q3: the least values that a quarter and three quarters of the group don't exceed."""
    every = Window.partitionBy(*group, "measure")  # at most as many rows as there are buckets
    upto = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sketch.select(*group, "measure", "bucket", F.sum("held").over(upto).alias("upto"), F.sum("held").over(every).alias("n"))

    def quantile(share: float) -> Column:
        return upper(F.min(F.when(F.col("upto") >= F.lit(share) * F.col("n"), F.col("bucket"))))

    return s.groupBy(*group, "measure").agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", spread: float = SPREAD) -> DataFrame:
    """One row per (lang, source): ``max_<measure>``, the larger of the group's and the language's fence, within WIDEST of the latter."""
    groups = written(sketches(measured, lang, source), "quality-sketches")
    langs = groups.groupBy(lang, "measure", "bucket").agg(F.sum("held").alias("held"))
    least = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v)])[F.col("measure")]
    fence = F.col("q3") + F.lit(spread) * F.greatest(F.col("q3") - F.col("q1"), least)
    own = quartiles(groups, [lang, source]).select(lang, source, "measure", fence.alias("own"))
    wide = quartiles(langs, [lang]).select(F.col(lang).alias("__lang"), F.col("measure").alias("__m"), fence.alias("wide"))
    both = own.join(wide, F.col(lang).eqNullSafe(F.col("__lang")) & (F.col("measure") == F.col("__m")))
    limit = F.least(F.greatest("own", "wide"), F.lit(WIDEST) * F.col("wide"))
    return both.groupBy(lang, source).agg(*[F.max(F.when(F.col("measure") == k, limit)).alias(f"max_{k}") for k in MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; ``limits`` comes from :func:`thresholds`."""
    t = limits.select(F.col(lang).alias("__tl"), F.col(source).alias("__ts"), *[f"max_{k}" for k in MEASURES])
    joined = measured.join(t, F.col(lang).eqNullSafe(F.col("__tl")) & F.col(source).eqNullSafe(F.col("__ts")), "left")
    within = F.lit(True)
    for k, share in _shares().items():
        within = within & (share <= F.col(f"max_{k}"))
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
            .drop("__tl", "__ts", *[f"max_{k}" for k in MEASURES]))


def quality(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Per document: doc_id, lang, source, the counts, ``base_failed`` and ``kept``."""
    m = written(measure(docs, F.col("text"), [F.col("doc_id"), F.col("lang"), F.col("source")]), "quality-measures")
    return judge(m, written(thresholds(m, spread=spread), "quality-thresholds"))


def filter_quality(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The documents that the rules keep, all columns as they came.

    Rows and measures are written together, so each text is measured once, and the filter reads the counts
    (pushed into the measuring projections, it would repeat their expressions many times over).
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    groups = [F.col("lang").alias("__gl"), F.col("source").alias("__gs")]
    wide = written(measure(docs, F.col("text"), [row, *groups]), "quality-measures")
    limits = written(thresholds(wide, "__gl", "__gs", spread), "quality-thresholds")
    return judge(wide, limits, "__gl", "__gs").filter("kept").select("__row.*")
