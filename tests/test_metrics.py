"""Current vs banded decision flow metrics."""

import pytest

from riskbands.operators import bands as B
from riskbands.operators import metrics as M

from .conftest import tx_row


@pytest.fixture(scope="module")
def frames(make_tx):
    rows = [
        tx_row("l1", value=100.0),                                   # low, legit, approved
        tx_row("l2", value=50.0, decision="denied"),                 # low, legit, denied
        tx_row("l3", value=20.0),                                    # low, fraud
        tx_row("m1", value=300.0),                                   # mid, fraud, approved
        tx_row("m2", value=400.0, decision="denied"),                # mid, fraud, denied
        tx_row("m3", value=500.0),                                   # mid, legit, approved
        tx_row("h1", value=70.0, flags=(True, False, False, False)),  # high, legit, approved
    ]
    tx, fb = make_tx(rows, ["l3", "m1", "m2", "missing-1"])
    return tx, fb, B.risk_bands(tx, fb)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_current_flow(frames):
    tx, fb, _ = frames
    r = one(M.fraud_cost_current(tx, fb))
    assert r["total_transactions"] == 7 and r["total_frauds"] == 3
    assert r["total_fraud_transaction"] == pytest.approx(round(720 * 0.15, 2))
    assert r["fraud_rate"] == pytest.approx(300 / 7)
    assert r["total_fraud_cost"] == pytest.approx(108.0 + 0.15)
    r = one(M.revenue_current(tx, fb))
    assert r["total_approved_transaction"] == pytest.approx(round((100 + 500 + 70) * 0.15, 2))
    assert r["total_revenue"] == pytest.approx(100.5 - 108.0 - 0.35)
    assert one(M.approval_current(tx, fb))["total_approvals"] == 5
    assert one(M.false_positive_current(tx, fb))["soft_false_positives"] == 3
    r = one(M.false_negative_current(tx, fb))
    assert (r["hard_false_negatives"], r["soft_false_negative"]) == (0, 2)
    assert one(M.twofa_cost_current(tx))["total_2fa_cost"] == pytest.approx(0.35)


def test_new_flow(frames):
    _, _, bands = frames
    r = one(M.fraud_cost_new(bands))
    assert (r["count_transactions"], r["count_frauds"], r["count_frauds_mid_band"]) == (7, 3, 2)
    assert r["total_frauds_low_band"] == 20.0 and r["total_frauds_mid_band"] == 700.0
    assert (r["count_low_band_denied"], r["total_low_band_denied"]) == (1, 50.0)
    assert r["total_fraud"] == pytest.approx(20 * 0.15 + 700 * 0.15)
    assert r["total_fraud_cost"] == pytest.approx(108.0 + 0.1)
    assert r["total_fraud_cost_realistic_case"] == pytest.approx(108.1 + (300 / 7 / 100) * 200 * 1 * 0.15)
    r = one(M.twofa_cost_new(bands))
    assert (r["count_mid_band"], r["total_2fa_cost"]) == (3, 0.15)
    r = one(M.revenue_new(bands))
    assert r["total_approved"] == 100 + 50 + 20 + 300 + 500
    assert r["total_fraud_approved"] == 20 + 300 and r["total_fraud_denied"] == 400
    assert r["total_revenue"] == pytest.approx(145.5 - 48.0 - 60.0 - 0.15)
    assert r["worst_case_scenario"] == pytest.approx(r["total_revenue"] - 7.5)
    assert one(M.approval_new(bands))["count_approved"] == 5
    r = one(M.false_positive_new(bands))
    assert (r["hard_false_positives"], r["soft_false_positives"]) == (1, 1)
    r = one(M.false_negative_new(bands))
    assert (r["hard_false_negative"], r["soft_false_negative"]) == (1, 1)


def test_empty_input_gives_one_row_and_null_rates(make_tx):
    tx, fb = make_tx([])
    bands = B.risk_bands(tx, fb)
    for df in [M.fraud_cost_current(tx, fb), M.fraud_cost_new(bands), M.revenue_current(tx, fb),
               M.revenue_new(bands), M.approval_current(tx, fb), M.approval_new(bands),
               M.false_positive_current(tx, fb), M.false_positive_new(bands),
               M.false_negative_current(tx, fb), M.false_negative_new(bands),
               M.twofa_cost_current(tx), M.twofa_cost_new(bands)]:
        r = one(df)
        for k, v in r.items():
            if k.endswith("rate") or k == "total_approved":
                assert v is None, k


def test_no_mid_fraud_makes_total_fraud_null(make_tx):
    tx, fb = make_tx([tx_row("l1", value=10.0), tx_row("m1", value=900.0)], ["l1"])
    r = one(M.fraud_cost_new(B.risk_bands(tx, fb)))
    assert r["total_frauds_mid_band"] is None and r["total_fraud"] is None


def test_duplicate_ids_count_once(make_tx):
    tx, fb = make_tx([tx_row("d", value=10.0), tx_row("d", value=10.0)], ["d", "d"])
    r = one(M.fraud_cost_current(tx, fb))
    # two rows x two feedback rows fan out to four joined rows: sums see all, counts dedupe
    assert (r["total_transactions"], r["total_frauds"]) == (1, 1)
    assert r["total_fraud_transaction"] == pytest.approx(6.0)


def test_feedback_ids_must_be_strings(spark, make_tx):
    import pytest

    from riskbands.operators import bands

    tx, fb = make_tx([tx_row("007"), tx_row("7"), tx_row("abc")], ["7"])
    assert {r.transaction_id: r.is_fraud for r in bands.label_fraud(tx, fb).collect()} == {"007": 0, "7": 1, "abc": 0}
    numbers = spark.createDataFrame([(7,)], "transaction_id int")
    for report in (bands.label_fraud, M.fraud_cost_current):
        with pytest.raises(TypeError, match="string"):
            report(tx, numbers)
