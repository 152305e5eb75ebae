"""High / mid / low bands, labelling and the evidence base."""

from riskbands.operators import bands as B
from riskbands.policy import Policy

from .conftest import tx_row

T = (True, False, False, False)


def bands_of(make_tx, rows, feedback=(), policy=Policy()):
    tx, fb = make_tx(rows, feedback)
    return {r.transaction_id: r.risk_band for r in B.risk_bands(tx, fb, policy).collect()}


def test_rules(make_tx):
    rows = [tx_row("flag", flags=T), tx_row("far", distance=1_000_000.01),
            tx_row("edge", distance=1_000_000.0), tx_row("nullflag", flags=(None, False, False, False))]
    tx, _ = make_tx(rows)
    assert {r.transaction_id for r in B.rule_any_flag(tx).collect()} == {"flag"}
    assert {r.transaction_id for r in B.rule_far_distance(tx).collect()} == {"far"}


def test_low_mid_high(make_tx):
    rows = [tx_row("low"), tx_row("mid_value", value=200.0), tx_row("mid_dist", distance=10_000.0),
            tx_row("mid_age0", age=0), tx_row("high", flags=T, device="other")]
    assert bands_of(make_tx, rows) == {"low": "low", "mid_value": "mid", "mid_dist": "mid",
                                       "mid_age0": "mid", "high": "high"}


def test_each_null_makes_a_low_row_mid(make_tx):
    rows = [tx_row("v", value=None), tx_row("d", distance=None), tx_row("a", age=None)]
    for i in range(4):
        flags = [False] * 4
        flags[i] = None
        rows.append(tx_row(f"f{i}", flags=tuple(flags)))
    assert set(bands_of(make_tx, rows).values()) == {"mid"}


def test_bands_partition_every_row_once(make_tx):
    rows = [tx_row(f"t{i}", ts=i, account=f"a{i % 6}", value=float(i * 37 % 400),
                   distance=float(i * 911 % 30000)) for i in range(40)]
    tx, fb = make_tx(rows, ["t1", "t2"])
    out = B.risk_bands(tx, fb).collect()
    assert len(out) == 40 and {r.risk_band for r in out} <= {"low", "mid", "high"}
    high = {r.transaction_id for r in B.high_risk_band(tx).collect()}
    assert high == {r.transaction_id for r in out if r.risk_band == "high"}
    ml = {r.transaction_id for r in B.medium_low_band(tx, fb).collect()}
    assert ml == {r.transaction_id for r in out if r.risk_band != "high"}


def test_shared_device_is_high(make_tx):
    rows = [tx_row(f"t{i}", ts=i, account=f"a{i}") for i in range(5)]
    got = bands_of(make_tx, rows)
    assert got["t3"] == "high" and got["t4"] == "high" and got["t0"] == "low"


def test_label_fraud_keeps_left_join_fanout_and_null_ids(make_tx):
    rows = [tx_row("t1"), tx_row("t2"), tx_row(None)]
    tx, fb = make_tx(rows, ["t1", "t1", None, "missing-9"])
    got = sorted((r.transaction_id or "", r.is_fraud) for r in B.label_fraud(tx, fb).collect())
    assert got == [("", 0), ("t1", 1), ("t1", 1), ("t2", 0)]


def test_null_id_is_never_high(make_tx):
    rows = [tx_row(None, flags=T), tx_row("t2")]
    tx, fb = make_tx(rows)
    got = {(r.transaction_id, r.risk_band) for r in B.risk_bands(tx, fb).collect()}
    # the flag cannot match the high band through a null id; the low rule ignores flag values
    assert got == {(None, "low"), ("t2", "low")}
    ml = B.medium_low_band(tx, fb).collect()
    assert {r.transaction_id for r in ml} == {None, "t2"}
    assert {r.has_null_value for r in ml} == {0}


def test_band_counts(make_tx):
    rows = [tx_row("a"), tx_row("b", value=500.0), tx_row("c", value=600.0)]
    tx, fb = make_tx(rows)
    got = [(r.risk_band, r.total_transactions) for r in B.band_counts(B.risk_bands(tx, fb)).collect()]
    assert got == [("low", 1), ("mid", 2)]


def test_non_high_risk_base_keeps_far_rows(make_tx):
    rows = [tx_row("far", distance=5_000_000.0), tx_row("flag", flags=T)]
    tx, fb = make_tx(rows, ["far"])
    got = [(r.transaction_id, r.is_fraud) for r in B.non_high_risk_base(tx, fb).collect()]
    assert got == [("far", 1)]


def test_sql_text_labelling_equals_dataframe_form(spark, make_tx):
    rows = [tx_row("t1"), tx_row("t2"), tx_row(None), tx_row("t1", value=9.0)]
    tx, fb = make_tx(rows, ["t1", "t1", None, "x"])
    a = sorted(tuple("" if v is None else v for v in r) for r in B.label_fraud(tx, fb).collect())
    b = sorted(tuple("" if v is None else v for v in r) for r in B.label_fraud_sql(spark, tx, fb).collect())
    assert a == b and len(a) == 6
