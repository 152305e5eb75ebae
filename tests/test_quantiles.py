"""Exact quantiles equal numpy's linear quantiles; the plan is lazy and the same at every size."""

import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbands.operators import stats as S
from riskbands.operators.quantiles import DIGIT, double_of, exact_quantiles, ordered_bits, with_bits

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def got(spark, columns):
    rows = list(zip(*columns, strict=True))
    cols = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    return {r.k: r.q for r in exact_quantiles(df, cols, PROBS).collect()}


def test_many_columns_against_numpy(spark):
    rnd = random.Random(3)
    n = 1200
    columns = [
        [rnd.gauss(0, 1000) for _ in range(n)],
        [rnd.choice([0.0, -0.0, -3.0, 1.0, 2.0, 2.0, 1e6]) for _ in range(n)],
        [1.7e12 + rnd.randrange(10**9) for _ in range(n)],
        [rnd.uniform(0, 1) if rnd.random() < 0.99 else 1e300 for _ in range(n)],
        [None if rnd.random() < 0.3 else rnd.uniform(-5, 5) for _ in range(n)],
        [7.0] * n, [None] * n, [None] * (n - 2) + [1.0, 2.0],
    ]
    out = got(spark, columns)
    assert 6 not in out
    for k, column in enumerate(columns):
        values = [v for v in column if v is not None]
        if values:
            assert out[k] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_nan_and_infinity_come_last(spark):
    out = got(spark, [[math.nan, 1.0, -math.inf, 2.0, math.inf]])[0]
    assert out[0] == -math.inf and out[3] == 2.0 and math.isnan(out[-1])


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, ["x"], PROBS).collect() == []
    assert S.describe(df, ["x"]).first().p50 is None


def test_bits_order_as_the_doubles_and_tell_them(spark):
    rnd = random.Random(5)
    values = [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-320, 308) for _ in range(2000)]
    values += [rnd.choice([-1, 1]) * 2.0 ** rnd.randrange(-1074, 1024) for _ in range(500)]
    values += [0.0, 1e308, -1e308, 1.7976931348623157e308, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
               math.inf, -math.inf, 1 - 2**-53, 1.0, 1 + 2**-52, 2.0, math.nextafter(2.0, 0), math.nextafter(8.0, 0)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    rows = df.select("x", ordered_bits(F.col("x")).alias("b")).select("x", "b", double_of(F.col("b")).alias("back")).collect()
    for r in rows:
        own = int.from_bytes(struct.pack(">d", abs(r.x)), "big")
        assert r.b == (own if r.x >= 0 else -own) and r.back == r.x
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_at_most_digits_times_prefixes_are_shuffled(spark):
    """100,000 distinct values: no task sends more than its counts of digits, and no window runs over values."""
    df = spark.range(100_000).selectExpr("exp(id / 7000e0) as x", "id * 1000e0 + 1.7e12 as y")
    plan = exact_quantiles(df, ["x", "y"], PROBS)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        assert not ("windowspecdefinition" in line and re.search(r"\b(x|y|bits)#", line)), line
    got = {r.k: r.q for r in plan.collect()}
    x, y = np.exp(np.arange(100_000) / 7000.0), np.arange(100_000) * 1000.0 + 1.7e12
    assert got[0] == pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12)
    assert got[1] == pytest.approx(list(np.quantile(y, PROBS)), rel=1e-15)
    assert 65 % DIGIT == 0


def test_building_runs_no_job(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as transaction_value", "cast(id as double) as device_age_days",
                                      "cast(id as double) as distance_to_frequent_location")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    for frame in (S.describe(df, df.columns), S.box_stats(df), S.quantile_table(df, df.columns),
                  S.histogram(df, "transaction_value", "auto")):
        assert frame.columns
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_histogram_of_many_bins(spark):
    df = spark.range(2000).selectExpr("cast(id as double) as x")
    h = S.histogram(df, "x", 20_000)
    assert h.count() == 20_000 and h.agg({"count": "sum"}).first()[0] == 2000


def test_each_pass_works_the_bits_out_once_a_row(spark):
    """The formula stands once in each pass, whatever the columns, and in no pushed-down filter."""
    df = spark.range(1000).selectExpr("exp(id / 700e0) as x", "if(id % 3 = 0, null, id * 1e0) as y", "id % 7 - 3e0 as z")
    plan = exact_quantiles(df, ["x", "y", "z"], PROBS)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("log2(") == 65 // DIGIT
    for line in text.splitlines():
        assert "pow" not in line.lower() or "Project" in line, line
    got = {r.k: r.q for r in plan.collect()}
    rows = [(r.x, r.y, r.z) for r in df.collect()]
    for k in range(3):
        values = [r[k] for r in rows if r[k] is not None]
        assert got[k] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_bits_step_by_step_are_those_of_the_one_formula(spark):
    values = [0.0, -0.0, 1.5, -1.5, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1 - 2**-53]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    step = {r.k: r.bits for r in with_bits(df, "x").collect()}
    assert step == {r.k: r.bits for r in df.select("k", ordered_bits(F.col("x")).alias("bits")).collect()}
