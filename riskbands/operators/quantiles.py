"""Exact quantiles of many columns by radix selection, in one lazy plan that is the same at every size.

Linear interpolation between order statistics, as Spark ``percentile`` / numpy / DuckDB ``quantile_cont``:

1. every value becomes a long whose order is that of the doubles (sign, exponent and fraction, as in its 64 bits);
2. a pass reads the next DIGIT bits of it: it counts the values per (column, prefix, digit), combined map-side, and a
   running sum over the digits of a prefix finds, for every wanted rank, the digit that holds it;
3. the prefixes so found (at most two for each probability) go on to the next pass, which looks at their values only;
4. after the last pass the long is known in full and turned back into its double.

A task sends at most columns x prefixes x 2 ** DIGIT counts a pass, whatever its rows; no value is shuffled or sorted.
The prefixes are broadcast, being so few. Nothing is collected, approximated or switched by size, and no job runs before
an action. NaN counts as greater than any number, and -0.0 as 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ident

DIGIT = 13
BITS = 65  # a multiple of DIGIT, one more than a double has
FRACTION = 52
LEAST_EXPONENT = -1022
_INFINITE = 2047 << FRACTION
_NAN = _INFINITE + 1


def _guess(size: Column) -> Column:
    """The power of two below ``size``, at most one off."""
    return F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(LEAST_EXPONENT)).cast("int")


def _scaled(size: Column, e: Column) -> Column:
    """``size`` divided by that power, in two steps: neither power leaves the range of doubles."""
    half = F.shiftright(e, 1)
    return size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), -(e - half))


def _exponent(guess: Column, m: Column) -> Column:
    return F.when(m >= 2, guess + 1).when((m < 1) & (guess > LEAST_EXPONENT), guess - 1).otherwise(guess)


def _fraction(guess: Column, m: Column) -> Column:
    return F.when(m >= 2, m / 2).when((m < 1) & (guess > LEAST_EXPONENT), m * 2).otherwise(m)


def _bits(x: Column, e: Column, m: Column) -> Column:
    size = F.abs(x)
    normal = F.shiftleft((e - F.lit(LEAST_EXPONENT)).cast("long"), FRACTION) + (m * F.lit(2.0**FRACTION)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), F.lit(_INFINITE)).otherwise(normal)
    return F.when(F.isnan(x), F.lit(_NAN)).when(x < 0, -bits).otherwise(bits)


def ordered_bits(x: Column) -> Column:
    """A long that orders as the double ``x`` does, and tells it: the bits of its size, negated below zero.

    Built by exact steps only: the power of two below the size (corrected where the logarithm is one off), the size
    divided by it, the fraction of that. Sizes below the least normal double are multiples of the least double.
    One expression repeats each step wherever the next one names it; many rows take :func:`with_bits`.
    """
    guess = _guess(F.abs(x))
    m = _scaled(F.abs(x), guess)
    return _bits(x, _exponent(guess, m), _fraction(guess, m))


def with_bits(rows: DataFrame, x: str) -> DataFrame:
    """``rows``, none null in ``x``, with the column ``bits``: :func:`ordered_bits` of ``x``, which is dropped.

    Each step is a projection of its own, so Spark works it out once for a row. ``bits`` is declared without nulls:
    a join on it would else push "is not null" of the whole formula, its steps repeated in each other, below them.
    """
    keep = [c for c in rows.columns if c != x]
    d = rows.select(*keep, x, _guess(F.abs(x)).alias("__g"))
    d = d.select(*keep, x, "__g", _scaled(F.abs(x), F.col("__g")).alias("__m"))
    g, m = F.col("__g"), F.col("__m")
    d = d.select(*keep, x, _exponent(g, m).alias("__e"), _fraction(g, m).alias("__f"))
    return d.select(*keep, F.coalesce(_bits(F.col(x), F.col("__e"), F.col("__f")), F.lit(0).cast("long")).alias("bits"))


def double_of(bits: Column) -> Column:
    """The double that :func:`ordered_bits` made ``bits`` of."""
    size = F.abs(bits)
    e = F.greatest(F.shiftright(size, FRACTION) - 1, F.lit(0).cast("long"))
    m = (size - F.shiftleft(e, FRACTION)).cast("double")
    half = F.shiftright(e + F.lit(LEAST_EXPONENT - FRACTION).cast("long"), 1)
    value = m * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e + F.lit(LEAST_EXPONENT - FRACTION) - half)
    return (F.when(bits == _NAN, F.lit(float("nan"))).when(size == _INFINITE, F.signum(bits) * F.lit(float("inf")))
            .otherwise(F.signum(bits) * value))


def _ranks(n: Column, probs) -> Column:
    """The 0-based ranks on both sides of each probability's place among ``n`` values."""
    places = [F.lit(float(p)) * (n - 1) for p in probs]
    return F.array_distinct(F.array(*[f(place).cast("long") for place in places for f in (F.floor, F.ceil)]))


def _prefix(bits: Column, left: int) -> Column:
    """``bits`` without its ``left`` lowest ones; shifting keeps the order of negative numbers, too."""
    return F.shiftright(bits, left)


def order_statistics(frame: DataFrame, cols, probs) -> DataFrame:
    """(k, n, r, x): for column number k with n non-null values, the value x at each needed rank r."""
    # one column under the other first: the steps to the bits are code for one column, however many there are
    tall = frame.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    tall = tall.selectExpr(f"stack({len(list(cols))}, " + ", ".join(f"{k}, c{k}" for k in range(len(list(cols)))) + ") AS (k, x)")
    tall = with_bits(tall.where(F.col("x").isNotNull()), "x")
    column, before = Window.partitionBy("k"), (Window.unboundedPreceding, -1)
    found = None
    for left in range(BITS - DIGIT, -1, -DIGIT):
        rows = tall
        if found is not None:
            # at most two prefixes for each probability and column
            rows = tall.join(F.broadcast(found), (F.col("k") == F.col("fk")) & (_prefix(F.col("bits"), left + DIGIT) == F.col("prefix")))
        state = [F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("n")] if found is None else ["below", "n"]
        counts = (rows.select("k", _prefix(F.col("bits"), left).alias("digit"), *state)
                  .groupBy("k", "digit", "below", "n").agg(F.count(F.lit(1)).alias("held")))
        if found is None:
            counts = counts.withColumn("n", F.sum("held").over(column))
        # the digits below one prefix: at most 2 ** DIGIT rows
        group = ["k"] if found is None else ["k", _prefix(F.col("digit"), DIGIT)]
        inside = Window.partitionBy(*group).orderBy("digit").rowsBetween(*before)
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("held").over(inside), F.lit(0)))
        wanted = F.filter(_ranks(F.col("n"), probs), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("held")))
        counts = counts.withColumn("ranks", wanted).where(F.size("ranks") > 0)
        found = counts.select(F.col("k").alias("fk"), F.col("digit").alias("prefix"), "below", "n", "ranks")
        if left:
            found = found.drop("ranks")
    return found.select(F.col("fk").alias("k"), "n", F.explode("ranks").alias("r"), double_of(F.col("prefix")).alias("x"))


def exact_quantiles(frame: DataFrame, cols, probs) -> DataFrame:
    """(k, q): the array of quantiles at ``probs`` of column number k; no row for a column without values."""
    per_column = order_statistics(frame, cols, probs).groupBy("k").agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("at"))

    def quantile(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return per_column.select("k", F.array(*[quantile(p) for p in probs]).alias("q"))


def quantile_map(frame: DataFrame, cols, probs) -> Column:
    """:func:`exact_quantiles` as one scalar subquery: a map from column number to its quantiles."""
    q = exact_quantiles(frame, cols, probs)
    return q.agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("m")).scalar()
