"""Descriptive statistics as Spark jobs (the analysis did these in pandas on the driver).

Each statistic is one aggregate pass; where another pass needs its numbers (quantiles, z-score,
box-plot fences, histogram range) they come in as one scalar subquery, projected once as a
column, so no cross join is involved.  Operators that build on each other (a histogram of z-filtered rows)
would nest such subqueries and plan each of them again at every reference: there ``moments`` and
``histogram_grid`` evaluate the one row of numbers once, and the next operator takes it (``at``) as constants.
Wide lists of output rows are written as one SQL expression, one JVM call.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ident, sql_str
from ..policy import DEFAULT, Policy
from .profile import CLEAN_COLUMNS, NUMERIC_COLUMNS
from .quantiles import quantile_map


def quantiles_of(frame: DataFrame, cols, probs, policy: Policy = DEFAULT) -> Column:
    """A map from column number to the array of its quantiles, as one scalar subquery.

    Exact by default (linear interpolation, as pandas / numpy); ``policy.quantile_method="approx"``
    takes ``percentile_approx`` instead.  A column without values has no entry.
    """
    probs = [float(p) for p in probs]
    if policy.quantile_method == "approx":
        found = [F.struct(F.lit(k).alias("k"), F.percentile_approx(
            F.col(c).cast("double"), probs, policy.approx_accuracy).alias("q")) for k, c in enumerate(cols)]
        return frame.agg(F.map_from_entries(F.array(*found)).alias("m")).scalar()
    return quantile_map(frame, cols, probs)


def _at(k: int) -> str:
    """SQL for the quantiles of column number k in the map column ``_q``; null if it has no values."""
    return f"try_element_at(`_q`, {k})"


def clean(frame: DataFrame, cols=CLEAN_COLUMNS) -> DataFrame:
    """Rows with no null in ``cols`` (pandas dropna(subset=cols))."""
    return frame.dropna(subset=list(cols))


def describe(frame: DataFrame, cols=NUMERIC_COLUMNS, policy: Policy = DEFAULT) -> DataFrame:
    """pandas-style describe as tidy rows:
    (column_name, count, mean, std, min, p25, p50, p75, max); std is the sample std."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    one = frame.agg(*aggs).withColumn("_q", quantiles_of(frame, cols, (0.25, 0.5, 0.75), policy))
    rows = ", ".join(
        f"named_struct('column_name', {sql_str(c)}, 'count', {ident(c + '__n')},"
        f" 'mean', {ident(c + '__mean')}, 'std', {ident(c + '__std')}, 'min', {ident(c + '__min')},"
        f" 'p25', {_at(k)}[0], 'p50', {_at(k)}[1], 'p75', {_at(k)}[2],"
        f" 'max', {ident(c + '__max')})" for k, c in enumerate(cols))
    return one.selectExpr(f"inline(array({rows}))")


def quantile_table(frame: DataFrame, cols=CLEAN_COLUMNS, policy: Policy = DEFAULT) -> DataFrame:
    """One row per probability in ``policy.quantiles`` with each column's quantile."""
    probs = policy.quantiles
    one = frame.sparkSession.range(1).select(quantiles_of(frame, cols, probs, policy).alias("_q"))
    rows = ", ".join(
        "named_struct('quantile', CAST({p} AS DOUBLE), {fields})".format(
            p=repr(float(p)), fields=", ".join(f"{sql_str(c)}, {_at(k)}[{i}]" for k, c in enumerate(cols)))
        for i, p in enumerate(probs))
    return one.selectExpr(f"inline(array({rows}))")


def box_stats(frame: DataFrame, cols=("transaction_value", "distance_to_frequent_location",
                                      "device_age_days"), policy: Policy = DEFAULT,
              whis: float = 1.5) -> DataFrame:
    """Box-plot numbers per column (nulls dropped per column, as a box plot does):
    (column_name, count, q1, median, q3, whisker_low, whisker_high, outliers).

    Whiskers reach the most extreme data point within ``whis`` * IQR of the box; when no
    point qualifies the whisker sits on the box edge.  Outliers are points beyond the fences.
    """
    # the quartiles enter the pass over the data as one scalar subquery, projected once as a column
    # (referencing a subquery many times makes the optimizer plan every copy)
    withq = frame.select(*[F.col(c).cast("double").alias(c) for c in cols],
                         quantiles_of(frame, cols, (0.25, 0.5, 0.75), policy).alias("_q"))
    aggs = [F.first("_q").alias("_q")]
    for k, c in enumerate(cols):
        x = F.col(c)
        q1, q3 = F.expr(f"{_at(k)}[0]"), F.expr(f"{_at(k)}[2]")
        lo_fence = q1 - F.lit(whis) * (q3 - q1)
        hi_fence = q3 + F.lit(whis) * (q3 - q1)
        aggs += [F.count(x).alias(f"{c}__n"),
                 F.min(F.when(x >= lo_fence, x)).alias(f"{c}__wlo"),
                 F.max(F.when(x <= hi_fence, x)).alias(f"{c}__whi"),
                 F.count(F.when((x < lo_fence) | (x > hi_fence), x)).alias(f"{c}__out")]
    one = withq.agg(*aggs)
    rows = []
    for k, c in enumerate(cols):
        q = _at(k)
        wlo, whi = ident(c + "__wlo"), ident(c + "__whi")
        rows.append(
            f"named_struct('column_name', {sql_str(c)}, 'count', {ident(c + '__n')},"
            f" 'q1', {q}[0], 'median', {q}[1], 'q3', {q}[2],"
            f" 'whisker_low', CASE WHEN {wlo} IS NULL OR {wlo} > {q}[0] THEN {q}[0] ELSE {wlo} END,"
            f" 'whisker_high', CASE WHEN {whi} IS NULL OR {whi} < {q}[2] THEN {q}[2] ELSE {whi} END,"
            f" 'outliers', {ident(c + '__out')})")
    return one.selectExpr(f"inline(array({', '.join(rows)}))")


class Moments(NamedTuple):
    """Mean and population standard deviation of a column; null without values."""

    mean: float | None
    std: float | None


def _moments(frame: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return frame.agg(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias("z"))


def moments(frame: DataFrame, column: str) -> Moments:
    """The moments, evaluated once: one pass that ends in one row."""
    z = _moments(frame, column).first()["z"]
    return Moments(z.m, z.s)


def zscore_filter(frame: DataFrame, column: str, cut: float, at: Moments | None = None) -> DataFrame:
    """Rows whose population z-score on ``column`` is within (-cut, cut); nulls drop.

    ``at``: the moments, if they are at hand; else they are a scalar subquery over ``frame``.
    """
    x = F.col(column).cast("double")
    if at is None:
        z = _moments(frame, column).scalar()
    else:
        z = F.struct(F.lit(at.mean).cast("double").alias("m"), F.lit(at.std).cast("double").alias("s"))
    # a constant column has std 0: every z is undefined and no row is kept
    return (frame.withColumn("_z", z)
            .where(F.abs(F.try_divide(x - F.col("_z.m"), F.col("_z.s"))) < F.lit(cut))
            .drop("_z"))


def mask(frame: DataFrame, keep: Column) -> DataFrame:
    """Every row, with all columns null where ``keep`` is not true (pandas ``DataFrame.where``)."""
    return frame.select(*[F.when(keep, F.col(c)).alias(c) for c in frame.columns])


class Grid(NamedTuple):
    """What a histogram's bins are made of: number of values, range and number of bins."""

    n: int
    lo: float | None
    hi: float | None
    nb: int | None


def _grid(frame: DataFrame, column: str, bins: int | str, policy: Policy) -> DataFrame:
    """The one row (s: struct of n, lo, hi, nb) of :func:`histogram`."""
    vals = frame.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    st = vals.agg(F.count("x").alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    if bins == "auto":
        st = st.withColumn("_q", quantiles_of(vals, ["x"], (0.25, 0.75), policy)).withColumn("q", F.expr(_at(0)))
        ptp = F.col("mx") - F.col("mn")
        n = F.col("n").cast("double")
        sturges = ptp / (F.log2(n) + F.lit(1.0))
        fd = F.lit(2.0) * (F.col("q")[1] - F.col("q")[0]) * F.pow(n, F.lit(-1.0 / 3.0))
        width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
        nb = F.when(width > 0, F.ceil(ptp / width)).otherwise(F.lit(1)).cast("long")
    else:
        nb = F.lit(int(bins)).cast("long")
    same = F.col("mn") == F.col("mx")
    return st.select(F.struct(
        F.col("n").alias("n"),
        F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
        nb.alias("nb")).alias("s"))


def histogram_grid(frame: DataFrame, column: str, bins: int | str = 50, policy: Policy = DEFAULT) -> Grid:
    """The range and number of bins, evaluated once: the passes over the data end in one row."""
    return Grid(*_grid(frame, column, bins, policy).first()["s"])


def histogram(frame: DataFrame, column: str, bins: int | str = 50,
              policy: Policy = DEFAULT, at: Grid | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of the non-null values, every bin listed:
    (bin, bin_start, bin_end, count).  The last bin is closed on the right.

    ``bins`` is a count or "auto" (the smaller bin width of the Sturges and Freedman-Diaconis
    rules, as numpy's "auto").  Two passes over the data: range statistics (a scalar
    subquery, or ``at`` from :func:`histogram_grid`), then bin counts; the full bin grid is generated
    from the tiny count table.
    """
    x = F.col(column).cast("double")
    vals = frame.select(x.alias("x")).where(F.col("x").isNotNull())
    if at is None:
        s = _grid(frame, column, bins, policy).scalar()
    else:
        s = F.struct(*[F.lit(v).cast(t).alias(k) for (k, v), t in zip(at._asdict().items(), ("long", "double", "double", "long"),
                                                                      strict=True)])
    lo, hi, k = F.col("_s.lo"), F.col("_s.hi"), F.col("_s.nb")
    step = (hi - lo) / k

    def start(b: Column) -> Column:
        return lo + b * step

    def end(b: Column) -> Column:
        return F.when(b + 1 == k, hi).otherwise(lo + (b + 1) * step)

    # bin index as numpy computes it: scaled floor, then corrected against the bin edges
    i0 = F.least(F.floor((F.col("x") - lo) * (k / (hi - lo))), k - 1).cast("long")
    idx = (F.when(F.col("x") < start(i0), i0 - 1)
           .when((F.col("x") >= end(i0)) & (i0 != k - 1), i0 + 1).otherwise(i0))
    counts = (vals.select("x", s.alias("_s")).select(idx.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    # the grid of all bins, and beside each the count of the bins that hold anything
    b = F.col("bin")
    grid = (frame.sparkSession.range(1).select(s.alias("_s")).where(F.col("_s.n") > 0)
            .select("_s", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("bin")))
    return (grid.select(b, start(b).alias("bin_start"), end(b).alias("bin_end")).join(counts, "bin", "left")
            .withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).orderBy("bin"))


def correlation_matrix(frame: DataFrame, cols=NUMERIC_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson correlation for every ordered pair: (x, y, r).

    r = covar_pop(x, y) / (std_pop(x) * std_pop(y)) over the rows where both are present;
    null when a column is constant on those rows or there are none (no ANSI error, no NaN).

    Rows are grouped by which columns they have. In a group every pair of those columns is complete, so a group's
    state is its count, means and co-moments; a task keeps one state per group and Spark merges them pairwise
    (no second pass over the rows, which go into the aggregate as they are). The groups that have both columns of a
    pair, at most two to the number of columns, are then merged by the same formula, relative to one of the means.
    """
    cols = list(cols)
    xs = [f"x{k}" for k in range(len(cols))]
    values = frame.select(*[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs, strict=True)])
    has = F.concat(*[F.when(F.col(x).isNull(), "0").otherwise("1") for x in xs])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    states = values.groupBy(has.alias("has")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{k}") for k, x in enumerate(xs)],
        *[F.var_pop(x).alias(f"c{k}_{k}") for k, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs if i < j])
    tall = ", ".join(f"{k}, m{i}, m{j}, c{i}_{j}, c{i}_{i}, c{j}_{j}" for k, (i, j) in enumerate(pairs))
    groups = states.selectExpr("n", f"stack({len(pairs)}, {tall}) AS (k, a, b, ab, aa, bb)").where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    pair = Window.partitionBy("k")
    n = F.sum("n").over(pair)
    # relative to the least mean, equal means give exactly 0
    groups = groups.select("k", "n", "ab", "aa", "bb", (F.col("a") - F.min("a").over(pair)).alias("a"),
                           (F.col("b") - F.min("b").over(pair)).alias("b"))
    groups = groups.select("k", "n", "ab", "aa", "bb", (F.col("a") - F.sum(F.col("n") * F.col("a")).over(pair) / n).alias("a"),
                           (F.col("b") - F.sum(F.col("n") * F.col("b")).over(pair) / n).alias("b"))
    merged = groups.groupBy("k").agg(*[F.sum(F.col("n") * (F.col(c) + F.col(c[0]) * F.col(c[1]))).alias(c) for c in ("ab", "aa", "bb")])
    scale = F.sqrt("aa") * F.sqrt("bb")
    per_pair = merged.select("k", F.try_divide(F.col("ab"), F.when(scale != 0, scale)).alias("r"))
    # every ordered pair, from the unordered result (a tiny frame of at most len(pairs) rows)
    key = {p: k for k, p in enumerate(pairs)}
    order = ", ".join(f"named_struct('x', {sql_str(a)}, 'y', {sql_str(b)}, 'k', {key[min(i, j), max(i, j)]})"
                      for i, a in enumerate(cols) for j, b in enumerate(cols))
    keys = frame.sparkSession.range(1).selectExpr(f"inline(array({order}))")
    return keys.join(per_pair, "k", "left").select("x", "y", "r")
