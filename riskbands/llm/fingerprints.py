"""Operator 4: document fingerprints from closed syncmers (DataFrame and SQL functions only).

A text is a row of units: its words, each ideograph, kana or syllable block (scripts that put no space between words)
by itself; the characters of a text that is short or has hardly any word ends. Its k-mers are runs of K = 4 units, their
inner substrings the runs of S = 2 units. A k-mer is a closed
syncmer if one of its two outer substrings has the least hash of its three. That depends on the k-mer alone,
not on what surrounds it, so equal passages hold equal anchors wherever they stand: two thirds of all k-mers.
The two outer substrings tile the k-mer, and its hash is made of theirs. ``anchors`` returns positions (unit
index) and hashes.

The fingerprint (``prints``) is all of the text's distinct anchors with their first positions, whatever its length;
``sketches`` is a smaller form of it for keeping, which no query takes: of texts with more than WHOLE anchors those
whose hash is divisible by RATE. ``likeness`` and ``near`` match two fingerprints by position: equal hashes give the
distance between the places where they stand, and only anchors that share their distance with another one count (all
do if there are fewer than LONE). It is their number as a share of the anchors that the two have together.

``with_next`` pairs each document with the next one of a global order without a global sort in one task: ids alone
are range-partitioned and cut into blocks of consecutive ones, whose first keys are broadcast. Texts are shuffled once,
by block, and the first document of a block goes to the block before it, too. In a block each document finds the next
one beside it, so neither heads of texts nor fingerprints are shuffled.

Defined cases: null text is the empty text; a text of fewer than K units has one anchor (all its units), one
without units none and the empty fingerprint; two empty fingerprints are alike (1), an empty and another one
are not (0); null doc_ids come last in descending order, equal ids are ordered by their text's hash, rows of
equal id and text share their successor and each returns its row; a single document is its own successor; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbands.llm.common import adjacent, words, written

K, S = 4, 2
WHOLE, RATE = 64, 4
LONE = 4
BLOCK, MOST_BLOCKS = 128, 1 << 17  # documents in a block, more if the blocks would be too many to broadcast their first keys
SHORT = 120  # texts of fewer code points are taken by characters
LONG_WORDS = 40  # and those with fewer words than one for so many code points
SINGLE = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"
MARKS = "array<struct<hash: bigint, pos: int>>"


def units(text: Column) -> Column:
    """The units of a text that is not null."""
    apart = F.when(text.rlike(SINGLE), F.regexp_replace(text, f"({SINGLE})", " $1 ")).otherwise(text)
    return F.when(F.length(text) < SHORT, _letters(text)).otherwise(words(apart))


def _letters(text: Column) -> Column:
    """The code points that are no white space, one by one."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]"), F.lit(0))


def _marked(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``__w`` (units) and ``__a``: for each k-mer its hash if it is a closed syncmer, else null."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.select(*keep, "__t", units(F.col("__t")).alias("__w"))
    d = d.select(*keep, F.when(F.size("__w") * LONG_WORDS < F.length("__t"), _letters(F.col("__t"))).otherwise(F.col("__w")).alias("__w"))
    d = d.select(*keep, "__w", F.expr(adjacent("__w", "__w", 1, "xxhash64(a, b)")).alias("__q"))
    edges = adjacent("__q", "__q", 2, "struct(least(a, b) as l, xxhash64(a, b) as h)")
    d = d.select(*keep, "__w", "__q", F.expr(edges).alias("__e"))
    n = "size(__e)"
    return d.select(*keep, "__w", F.expr(
        f"zip_with(__e, slice(__q, 2, {n}), (e, m) -> if(e.l <= m, e.h, cast(null as bigint)))").alias("__a"))


def _short() -> Column:
    """The one anchor of a text of fewer than K units."""
    return F.when(F.size("__w") > 0, F.array(F.xxhash64(F.array_join("__w", " ")))).otherwise(
        F.array().cast("array<bigint>"))


def anchors(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``anchors``: an array of (pos, hash) in the order of the text."""
    d = _marked(docs, text, list(keep))
    found = F.filter(F.transform("__a", lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))),
                     lambda x: x["hash"].isNotNull())
    alone = F.transform(_short(), lambda h: F.struct(F.lit(0).alias("pos"), h.alias("hash")))
    return d.select(*keep, F.when(F.size("__w") < K, alone).otherwise(found).alias("anchors"))


def prints(docs: DataFrame, text: str, out: str) -> DataFrame:
    """The rows of ``docs`` with ``out``: the distinct anchors (hash, first position) of the text, by hash."""
    keep = docs.columns
    d = _marked(docs, text, keep)
    alone = F.transform(_short(), lambda h: F.struct(h.alias("hash"), F.lit(0).alias("pos")))
    found = F.filter(F.transform("__a", lambda h, i: F.struct(h.alias("hash"), i.alias("pos"))), lambda x: x["hash"].isNotNull())
    d = d.select(*keep, F.sort_array(F.when(F.size("__w") < K, alone).otherwise(found)).cast(MARKS).alias("__s"))
    return d.select(*keep, F.expr("filter(__s, (x, i) -> i = 0 or x.hash <> __s[i - 1].hash)").alias(out))


def sketches(docs: DataFrame, text: str, out: str) -> DataFrame:
    """As :func:`prints`, but of texts with many anchors a sample."""
    d = prints(docs, text, "__s")
    return d.select(*docs.columns, F.when(F.size("__s") <= WHOLE, F.col("__s")).otherwise(_sampled("__s")).alias(out))


def _sampled(marks: str) -> Column:
    return F.filter(marks, lambda x: F.pmod(x["hash"], F.lit(RATE)) == 0)


def fingerprint(sketch: str) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash and its position, in the order of the hashes."""
    return F.array_join(F.transform(F.col(sketch), lambda x: F.concat(
        F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit("."), F.lower(F.hex(x["pos"])))), ",")


def likeness(a: str, b: str) -> Column:
    """Share of the anchors of two sketches that match by position."""
    # a text taken whole is compared with a sampled one by what the sample takes; two small samples as they are
    def taken(x: str, other: str) -> str:
        return f"if({whole_sql(x)} and not {whole_sql(other)}, filter({x}, m -> pmod(m.hash, {RATE}) = 0), {x})"

    def whole_sql(x: str) -> str:
        return f"(exists({x}, m -> pmod(m.hash, {RATE}) <> 0) or size({x}) = 0)"

    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, {_matched(taken(a, b), taken(b, a))})")


def near(a: str, b: str) -> Column:
    """Share of the anchors of two fingerprints, as they are, that match by position."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, {_matched(a, b)})")


def _matched(a: str, b: str) -> str:
    sides = [f"transform({x}, m -> struct(m.hash as h, {k} as side, m.pos as p))" for k, x in enumerate([a, b])]
    return f"""
          transform(array(sort_array(concat({sides[0]}, {sides[1]}))),
            e -> transform(array(sort_array(flatten(zip_with(slice(e, 1, greatest(size(e) - 1, 0)), slice(e, 2, greatest(size(e) - 1, 0)),
                   (x, y) -> if(x.h = y.h and x.side < y.side, array(y.p - x.p), cast(array() as array<int>)))))),
              o -> coalesce(try_divide(
                cast(if(size(o) < {LONE}, size(o), size(filter(o, (d, i) -> d = get(o, i - 1) or d = get(o, i + 1)))) as double),
                size(e) - if(size(o) < {LONE}, size(o), size(filter(o, (d, i) -> d = get(o, i - 1) or d = get(o, i + 1))))), 0D))[0])[0]"""


def block_starts(keys: DataFrame) -> DataFrame:
    """One row: ``starts``, the first keys of the blocks in ascending order. ``keys`` has doc_id, thash and key."""
    ranges = keys.distinct().repartitionByRange(F.col("doc_id").desc_nulls_last())
    ranges = written(ranges.withColumn("__range", F.spark_partition_id()), "fingerprint-ids")
    size = max(BLOCK, -(-ranges.count() // MOST_BLOCKS))
    inside = Window.partitionBy("__range").orderBy("key")
    firsts = ranges.select("key", F.row_number().over(inside).alias("__n")).filter(F.col("__n") % size == F.lit(1))
    return written(firsts.agg(F.sort_array(F.collect_list("key")).alias("starts")), "fingerprint-blocks")


#: The number of starts that are at most ``key``, by bisection: (lo, hi] closes in on it.
_BLOCK = """aggregate(sequence(1, 1 + cast(ceil(log2(size(starts) + 1)) as int)), struct(0 as lo, size(starts) as hi),
    (s, x) -> if(s.lo >= s.hi, s, if(starts[(s.lo + s.hi + 1) div 2 - 1] <= key,
        struct(cast((s.lo + s.hi + 1) div 2 as int) as lo, s.hi as hi),
        struct(s.lo as lo, cast((s.lo + s.hi + 1) div 2 - 1 as int) as hi))), s -> s.lo)"""


def with_next(docs: DataFrame, part: int = 3) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document.

    The edited text has the last floor(n / part) code points replaced by the next document's first as many.
    Columns: doc_id, n_chars, edited (the text), sketch, edited_sketch, next_sketch. Rows are told apart by ``key``:
    whether the id is null, the id (its complement, so that the order falls), a hash of id and text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0)).cast("long")).alias("id"),
                   F.xxhash64("doc_id", "text").alias("thash"))
    base = base.select("doc_id", key.alias("key"), "text")
    starts = block_starts(base.select("doc_id", "key"))
    placed = base.join(F.broadcast(starts)).withColumn("__block", F.expr(_BLOCK))
    # the first document of a block is the one after the last of the block before (of the last block before the first)
    first = F.expr("starts[__block - 1] = key")
    before = F.expr("if(__block = 1, size(starts), __block - 1)")
    here = F.struct(F.col("__block").alias("block"), F.lit(False).alias("after"))
    places = F.when(first, F.array(here, F.struct(before.alias("block"), F.lit(True).alias("after")))).otherwise(F.array(here))
    placed = placed.select("doc_id", "key", "text", F.inline(places))
    falling = [F.desc("after"), F.desc("key")]
    # sorted before the fingerprints are taken: the sort holds texts alone
    d = prints(placed.repartition("block").sortWithinPartitions("block", *falling), "text", "sketch")
    line = Window.partitionBy("block").orderBy(*falling)
    place = F.struct("after", "key")
    d = d.withColumn("__next", F.when(F.lag(place).over(line) != place, F.lag(F.struct("text", "sketch")).over(line)))
    # rows of equal key share the next one
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__next", F.last("__next", ignorenulls=True).over(so_far)).filter("not after")
    need = f"cast(floor(length(text) / {part}) as int)"
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", F.col("__next.sketch").alias("next_sketch"),
                 F.expr(f"concat(left(text, length(text) - {need}), left(__next.text, {need}))").alias("edited"))
    return prints(d, "edited", "edited_sketch")
