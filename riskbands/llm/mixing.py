"""Operator 5: mix sources to target weights (DataFrame and SQL functions only).

Every document gets a hash-random key. Within a source the documents are ordered by key; the prefix sum of
their word counts says where each one starts, and the source's budget cuts that order at an exact place.
A budget above the source's own size first repeats the whole source (full epochs), then cuts a last epoch.

The prefix sum is distributed: the key's leading digits split a source into ``16 ** digits`` ranges of the
key. Range totals (pre-aggregated map-side) give each range its start by a running sum over the ranges of a
source; inside a range a running sum over its documents does the rest. A source that holds a third of all
rows is thus spread over that many window groups, and only ids, sizes and keys are shuffled, never texts.

Defined cases: null text has size 0 and takes 0 words; null source is a source, ordered last; a null id's key
comes from its text; equal keys
(repeated rows) are ordered by size, and rows equal in both share the running sum's order by row content, so
their takes are the same multiset in every run; an empty table gives an empty result; extra columns are
ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbands.llm.common import words, written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % of all words
CAP = 2
DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
            cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus ``target``: weight shares of the total, none above cap * source_size.

    Reshaping the excess by weight until no source is above its cap ends at min(cap_s, level * weight_s) for
    one common level. With the sources sorted by cap / weight, the level after the first j are capped is
    (total - caps of the first j) / (weights of the rest), and the first j whose level fits the next source's
    cap is the answer. The windows run over one row per source.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sizes.select("source", "source_size", F.row_number().over(order).alias("__n"))
    s = s.withColumn("__w", F.element_at(turn, ((F.col("__n") - 1) % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    fill = everything.orderBy((F.lit(cap) * F.col("source_size") / F.col("__w")).asc(), F.col("__n").asc())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*", (F.lit(cap) * F.col("source_size")).alias("__cap"),
        F.sum("source_size").over(everything).alias("__all"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)).alias("__capped"),
        F.sum("__w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__rest"))
    total = F.lit(share[0]) * F.col("__all")
    s = s.withColumn("__level", (total - F.lit(share[1]) * F.col("__capped")) / (F.lit(share[1]) * F.col("__rest")))
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    s = s.withColumn("__best", F.min_by(F.when(fits, F.col("__level")),
                                        F.when(fits, F.col("__rest") * -1)).over(everything))
    return s.select("source", "source_size", F.coalesce(
        F.least(F.col("__cap").cast("double"), F.col("__best") * F.col("__w")),
        F.col("__cap").cast("double")).alias("target"))


def sized(docs: DataFrame, carry: list[Column]) -> DataFrame:
    return docs.select(*carry, "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
        cap: int = CAP, digits: int = DIGITS, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, ``taken`` words and the epochs they span.

    ``taken`` sums to the source's target exactly (rounded down to whole words): the document at the cut is
    taken in part. ``__key`` orders the documents of a source at random, the same in every run.
    """
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), nameless)))
    d = written(sized(docs, [F.col("doc_id"), key.alias("__key"), *carry]), "mix-sizes")
    named = [c for c in d.columns if c not in ("doc_id", "source", "size", "__key")]
    d = d.withColumn("__range", F.substring("__key", 1, digits))
    ranges = d.groupBy("source", "__range").agg(F.sum("size").alias("__in"))
    ranges = written(ranges, "mix-ranges")
    limits = targets(ranges.groupBy("source").agg(F.sum("__in").alias("source_size")), weights, share, cap)
    limits = written(limits, "mix-targets").withColumnRenamed("source", "__s")
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "__range", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__start"))
    starts = starts.join(limits, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    starts = starts.withColumnsRenamed({"source": "__s", "__range": "__r"})
    inside = (Window.partitionBy("source", "__range").orderBy("__key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("epochs", whole)
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    place = F.col("__start") + F.col("__within")
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - place))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *named)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: a row for each epoch that takes any of a document's words.

    The last epoch's document at the cut is kept whole, so a source ends at most one document above its
    target. Rows of equal id, source and text: their takes are summed before the join, then spread over them.
    """
    plan = mix(docs, carry=(F.xxhash64("text").alias("__hash"),), **options).groupBy("doc_id", "source", "__hash").agg(
        F.sum("taken").alias("__taken"), F.sum("size").alias("__size")).filter("__taken > 0")
    plan = written(plan.withColumnsRenamed({"doc_id": "__id", "source": "__from", "__hash": "__of"}), "mix-plan")
    times = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    wide = docs.withColumn("__hash", F.xxhash64("text")).join(
        plan, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__from"))
        & (F.col("__hash") == F.col("__of")))
    return (wide.withColumn("__epoch", F.explode(F.sequence(F.lit(1), times)))
            .drop("__epoch", "__id", "__from", "__hash", "__of", "__taken", "__size"))
