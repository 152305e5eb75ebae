"""Saved derived tables give the same rows as the one-shot operators, and are read without a shuffle by id."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskbands.operators import bands as B
from riskbands.operators import evidence as E
from riskbands.operators import metrics as M
from riskbands.plans.tables import build_tables
from riskbands.sources import io as IO

from .conftest import tx_row


def rows(df):
    return sorted((tuple(repr(v) for v in r) for r in df.collect()))


@pytest.fixture(scope="module")
def frames(make_tx):
    rnd = random.Random(2)
    data = [tx_row(f"t{i if i % 9 else i // 3}", ts=i * 911_000, account=f"a{i % 5}", device=rnd.choice(["d1", "d2", None, f"e{i}"]),
                   value=rnd.choice([None, float(i * 53 % 700)]), age=rnd.choice([None, 0, i % 30]),
                   distance=rnd.choice([None, float(i * 7919 % 20000), 2e6]), decision=rnd.choice(["approved", "denied", "review"]),
                   flags=(i % 9 == 0, False, None if i % 7 == 0 else False, False)) for i in range(160)]
    data += [tx_row(None, ts=3, value=70.0), tx_row(None, ts=5, distance=99.0), tx_row(None, age=None, decision="denied")]
    return make_tx(data, ["t1", "t5", "t9", "t9", "t30", "missing-1", None])


@pytest.fixture(scope="module")
def stored(spark, frames):
    return build_tables(spark, *frames, buckets=4)


@pytest.fixture
def no_broadcast(spark):
    """Joins by sort and merge, so that only the layout can save a shuffle."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def id_shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\((_fb_id|_hr_id|transaction_id)#", x)]


def test_build_tables_matches_operators(frames, stored):
    tx, fb = frames
    assert rows(stored.high_risk_band) == rows(B.high_risk_band(tx).where(F.col(B.ID).isNotNull()))
    assert rows(stored.transactions_with_bands) == rows(B.risk_bands(tx, fb))
    assert rows(stored.transactions_without_high_risk) == rows(B.non_high_risk_base(tx, fb))
    assert rows(stored.transactions.whole()) == rows(tx)
    for name in M.NEW:
        assert rows(getattr(M, name)(stored.banded)) == rows(getattr(M, name)(B.risk_bands(tx, fb)))


def test_tables_hold_one_file_a_bucket(spark, stored):
    for df in (stored.transactions.known, stored.banded.known, stored.base.known, stored.high_risk_band, stored.feedback):
        assert len(df.inputFiles()) <= 4
        assert df.where(F.col(B.ID).isNull()).count() == 0


def test_joins_and_reductions_by_id_read_without_a_shuffle(spark, frames, stored, no_broadcast):
    tx, fb = frames
    t = stored
    frames = {
        "label join": B.label_halves(t.transactions, t.feedback).known,
        "anti join": B.label_halves(t.transactions, t.feedback, t.high_risk_band).known,
        "band join": B.risk_band_halves(t.transactions, t.feedback, high=t.high_risk_band).known,
        **{n: getattr(M, n)(t.banded) for n in M.NEW},
        **{n: getattr(M, n)(t.transactions, t.feedback) for n in M.CURRENT if n != "twofa_cost_current"},
        "twofa_cost_current": M.twofa_cost_current(t.transactions),
        "report": M.flow_report(t.banded), "evidence": E.evidence_report(t.base)}
    for name, df in frames.items():
        assert not id_shuffles(df), name
    # the same operators over plain files do shuffle by id
    assert id_shuffles(M.fraud_cost_current(tx, fb)) and id_shuffles(M.flow_report(B.risk_band_halves(tx, fb)))


def test_saving_a_join_of_bucketed_tables_moves_no_row(spark, stored):
    joined = B.label_halves(stored.transactions, stored.feedback.hint("merge")).known
    assert IO._buckets_of(joined, B.ID) == 4
    assert IO._buckets_of(joined, "device_id") is None and IO._buckets_of(joined.repartition(4), B.ID) is None


def test_report_equals_the_single_metrics(frames, stored):
    tx, fb = frames
    got = {}
    for r in M.flow_report(stored.banded).collect():
        got.setdefault(r.metric, {})[r.measure] = r.value
    assert list(got) == list(M.METRICS)
    singles = {n: getattr(M, n)(B.risk_bands(tx, fb)) for n in M.NEW}
    singles |= {n: getattr(M, n)(tx, fb) for n in M.CURRENT if n != "twofa_cost_current"}
    singles["twofa_cost_current"] = M.twofa_cost_current(tx)
    for name, df in singles.items():
        want = df.first().asDict()
        assert list(got[name]) == list(want)
        for k, v in want.items():
            assert got[name][k] == (None if v is None else pytest.approx(float(v), rel=1e-12)), (name, k)


def test_report_scans_and_reduces_once(stored):
    plan = M.flow_report(stored.banded)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # the rows with an id and those without
    assert len(re.findall(r"HashAggregate\(keys=\[transaction_id#\d+\]", plan)) <= 2  # partial and final


def test_evidence_report_equals_the_single_tables(frames, stored):
    tx, fb = frames
    base = B.non_high_risk_base(tx, fb)
    report = {}
    for r in E.evidence_report(stored.base).collect():
        report.setdefault(r.evidence, []).append((r.key, r.label, r.total_transactions, r.total_frauds, r.fraud_rate))
    for name in ("distance_ladder", "value_ladder", "age_ladder"):
        want = [(r.bin_rank, r[0], r.total_transactions, r.total_frauds, r.fraud_rate) for r in getattr(E, name)(base).collect()]
        assert sorted(report.pop(name), key=repr) == sorted(want, key=repr), name
    ages = [(r.device_age_days, None, r.total_transactions, r.total_is_fraud, r.fraud_rating)
            for r in E.fraud_by_device_age(base).collect()]
    assert sorted(report.pop("fraud_by_device_age"), key=repr) == sorted(ages, key=repr)
    hours = {r.ts_hour: (r.total_transactions, r.fraud_rate) for r in E.fraud_by_hour(base).collect()}
    assert {r[0]: (r[2], r[4]) for r in report.pop("fraud_by_hour")} == hours and not report


def test_evidence_report_scans_the_base_once(stored):
    plan = E.evidence_report(stored.base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Expand" not in plan


def test_empty_input(spark, make_tx):
    t = build_tables(spark, *make_tx([]), buckets=2)
    assert t.transactions_with_bands.count() == 0 and E.evidence_report(t.base).collect() == []
    report = {(r.metric, r.measure): r.value for r in M.flow_report(t.banded).collect()}
    assert report["approval_new", "count_transactions"] == 0 and report["approval_new", "total_approved"] is None


def rows_read(df):
    """Rows that the scan handed on after skipping row groups."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_rule_on_distance_reads_a_small_share(spark, make_tx):
    """2 % of 20,000 rows are far, a third have no distance: the rule reads one or two of 16 ranges."""
    tx, fb = make_tx([tx_row("t")])
    n = F.col("id")
    big = spark.range(20_000).select(F.concat(F.lit("t"), n).alias("transaction_id"),
                                     F.when(n % 3 == 0, F.lit(None)).when(n % 50 == 1, 2e6 + n).otherwise(n * 3.0)
                                     .cast("double").alias("distance_to_frequent_location"))
    for f in tx.schema.fields:
        if f.name not in big.columns:
            big = big.withColumn(f.name, F.lit(None).cast(f.dataType))
    t = build_tables(spark, big.select(tx.columns), fb, buckets=16)
    files = t.by_distance.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 16 and max(r["count"] for r in files) <= 2 * 20_000 / 16  # rows without distance are spread
    far = B.rule_far_distance(t.by_distance)
    assert far.count() == big.where("distance_to_frequent_location > 1000000").count() == 267
    assert rows_read(B.rule_far_distance(t.by_distance)) <= 2 * 20_000 / 16
    assert rows_read(B.rule_far_distance(t.transactions.known)) == 20_000
    one = t.by_distance.where("transaction_id = 't4711'")
    assert one.count() == 1 and rows_read(t.by_distance.where("transaction_id = 't4711'")) <= 3 * 20_000 / 16
