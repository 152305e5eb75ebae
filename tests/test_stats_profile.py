"""Statistics and profiles on hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbands.operators import evidence as E
from riskbands.operators import profile as P
from riskbands.operators import stats as S

from .conftest import tx_row


def test_flag_profile_suppresses_never_true_never_null(make_tx):
    rows = [tx_row("a", flags=(True, None, False, False)), tx_row("b", flags=(None, False, False, False))]
    tx, _ = make_tx(rows)
    got = {r.column_name: (r.total_true, r.total_nulls) for r in P.flag_profile(tx).collect()}
    assert got == {"is_emulator": (1, 1), "has_fake_location": (0, 1)}


def test_counts_per_attribute(make_tx):
    rows = [tx_row("a", ts=3_600_000 * 25, account="x", device="d1"),
            tx_row("b", ts=5, account="x", device="d2"), tx_row("c", ts=None, account="y", device="d1")]
    tx, _ = make_tx(rows)
    assert {(r.ts_hour, r.total_transactions) for r in P.tx_by_hour(tx).collect()} == {(1, 1), (0, 1), (None, 1)}
    assert {(r.account_id, r.total_devices) for r in P.devices_per_account(tx).collect()} == {("x", 2), ("y", 1)}
    assert {(r.device_id, r.total_accounts) for r in P.accounts_per_device(tx).collect()} == {("d1", 2), ("d2", 1)}
    assert [(r.client_decision, r.total_transactions) for r in P.tx_by_decision(tx).collect()] == [("approved", 3)]


def test_encode_and_null_counts(make_tx):
    rows = [tx_row("a", flags=(True, None, False, False), decision="review"), tx_row("b", decision="denied")]
    tx, fb = make_tx(rows, ["a"])
    enc = P.encode_features(tx, fb)
    got = {r.transaction_id: (r.is_emulator, r.has_fake_location, r.client_decision, r.is_fraud)
           for r in enc.collect()}
    assert got == {"a": (1, None, None, 1), "b": (0, 0, 0, 0)}
    nulls = {r.column_name: r.nulls for r in P.null_counts(enc).collect()}
    assert nulls["has_fake_location"] == 1 and nulls["client_decision"] == 1 and nulls["transaction_id"] == 0


def test_describe_and_quantiles_match_numpy(spark):
    vals = [1.0, 2.0, 2.0, 7.5, 10.0, None, 3.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = S.describe(df, ["x"]).collect()[0]
    arr = np.array([v for v in vals if v is not None])
    assert r["count"] == len(arr)
    assert r["mean"] == pytest.approx(arr.mean()) and r["std"] == pytest.approx(arr.std(ddof=1))
    assert [r.p25, r.p50, r.p75] == pytest.approx(list(np.percentile(arr, [25, 50, 75])))


def test_box_stats_whiskers_and_outliers(spark):
    vals = [0.0, 0.0, 0.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "transaction_value double")
    r = S.box_stats(df, ["transaction_value"]).collect()[0]
    assert (r.q1, r.median, r.q3) == (0.0, 0.0, 25.0)
    assert r.whisker_low == 0.0 and r.whisker_high == 25.0 and r.outliers == 1


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, None)], "a double, b double, c double")
    got = {(r.x, r.y): r.r for r in S.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None
    assert got[("a", "c")] == pytest.approx(1.0) and got[("c", "a")] == pytest.approx(1.0)
    assert len(got) == 9


def test_zscore_and_histogram(spark):
    vals = [float(v) for v in range(20)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "transaction_value double")
    kept = S.zscore_filter(df, "transaction_value", 3.0)
    assert kept.count() == 20
    h = S.histogram(kept, "transaction_value", 4).collect()
    counts, edges = np.histogram(np.arange(20.0), bins=4)
    assert [r["count"] for r in h] == list(counts)
    assert [r.bin_start for r in h] == pytest.approx(list(edges[:-1]))
    auto = S.histogram(kept, "transaction_value", "auto").collect()
    assert len(auto) == len(np.histogram_bin_edges(np.arange(20.0), bins="auto")) - 1
    assert sum(r["count"] for r in auto) == 20


def test_histogram_constant_and_empty(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = S.histogram(df, "x", 2).collect()
    assert [(r.bin_start, r.bin_end, r["count"]) for r in h] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]
    empty = spark.createDataFrame([], "x double")
    assert S.histogram(empty, "x", 5).collect() == []


def test_constant_zscore_keeps_nothing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "transaction_value double")
    assert S.zscore_filter(df, "transaction_value", 3.0).count() == 0


def test_fraud_by_hour_and_age(make_tx):
    from riskbands.operators.bands import label_fraud
    rows = [tx_row("a", ts=0, age=3), tx_row("b", ts=1, age=3), tx_row("c", ts=7_200_000, age=None)]
    tx, fb = make_tx(rows, ["a"])
    base = label_fraud(tx, fb)
    hours = {r.ts_hour: (r.total_transactions, r.fraud_rate) for r in E.fraud_by_hour(base).collect()}
    assert hours == {0: (2, 0.5), 2: (1, 0.0)}
    ages = {r.device_age_days: (r.total_is_fraud, r.total_transactions, r.fraud_rating)
            for r in E.fraud_by_device_age(base).collect()}
    assert ages == {3: (1, 2, 50.0), None: (0, 1, 0.0)}
    share = E.flag_fraud_share(*make_tx([tx_row("f", flags=(True, False, False, False))], ["f"])).collect()[0]
    assert (share.total_frauds, share.total_no_frauds) == (1.0, 0.0)
    assert not math.isnan(share.total_frauds)
    assert F is not None


def test_fraud_by_device_accounts(make_tx):
    rows = [tx_row(f"t{i}", ts=i, account=f"a{i}") for i in range(3)] + [tx_row("x", device=None)]
    tx, fb = make_tx(rows, ["t2"])
    got = {r.CountDistinct: (r.total_transactions, r.total_frauds, r.fraud_rate)
           for r in E.fraud_by_device_accounts(tx, fb).collect()}
    assert got == {1: (1, 0, 0.0), 2: (1, 0, 0.0), 3: (1, 1, 100.0)}
