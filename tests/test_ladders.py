"""Ladder bins: closed intervals, first match wins, exact at the edges."""

import math

import pytest

from riskbands.functions.ladders import AGE_LADDER, DISTANCE_LADDER, VALUE_LADDER
from riskbands.operators import evidence as E

from .conftest import tx_row


def label(spark, spec, values, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"{spec.column} {dtype}")
    ranked = df.select(spec.column, spec.rank().alias("r"))
    rows = ranked.select(spec.column, spec.label_of("r").alias("l")).collect()
    return [r.l for r in rows]


def test_distance_edges(spark):
    nxt = math.nextafter(1000.0, math.inf)
    vals = [0.0, 1000.0, nxt, 100000.0, 1000000.0, 1000000.01, -1.0, None]
    assert label(spark, DISTANCE_LADDER, vals) == [
        "0 and 1000", "0 and 1000", "1000 and 2000", "99000 and 100000", "900000 and 1000000",
        "> 1000km", "unknown", "unknown"]


def test_age_edges_and_gaps(spark):
    vals = [0, 10, 11, 500, 501, 581, 582, -3, None]
    assert label(spark, AGE_LADDER, vals, "int") == [
        "0 and 1", "9 and 10", "11 and 16", "496 and 500", "501 and 506", "576 and 581", "> 581",
        "unknown", "unknown"]
    assert label(spark, AGE_LADDER, [10.5], "double") == ["unknown"]


@pytest.mark.parametrize("spec", [DISTANCE_LADDER, VALUE_LADDER, AGE_LADDER])
def test_binary_search_equals_linear_first_match(spark, spec):
    vals = set()
    for lo, hi in spec.bins:
        for v in (lo, hi, (lo + hi) / 2, math.nextafter(hi, math.inf), math.nextafter(lo, -math.inf)):
            vals.add(float(v))
    vals = sorted(vals)
    got = label(spark, spec, vals)
    want = []
    for v in vals:
        hit = next((i for i, (lo, hi) in enumerate(spec.bins) if lo <= v <= hi), None)
        want.append(spec.labels[hit] if hit is not None else
                    (spec.top_label if v > spec.bins[-1][1] else "unknown"))
    assert got == want


def test_ladder_aggregates(make_tx):
    rows = [tx_row("a", distance=10.0), tx_row("b", distance=999.0), tx_row("c", distance=1500.0),
            tx_row("d", distance=None)]
    tx, fb = make_tx(rows, ["b"])
    from riskbands.operators.bands import label_fraud
    out = {r.distance_break: (r.bin_rank, r.total_transactions, r.total_frauds, r.fraud_rate)
           for r in E.distance_ladder(label_fraud(tx, fb)).collect()}
    assert out == {"0 and 1000": (1, 2, 1, 50.0), "1000 and 2000": (2, 1, 0, 0.0),
                   "unknown": (DISTANCE_LADDER.unknown_rank, 1, 0, 0.0)}


def test_value_ladder_drops_far_and_null_distance(make_tx):
    rows = [tx_row("a", value=5.0, distance=99_999.0), tx_row("b", value=5.0, distance=100_000.0),
            tx_row("c", value=5.0, distance=None)]
    tx, fb = make_tx(rows)
    from riskbands.operators.bands import label_fraud
    out = E.value_ladder(label_fraud(tx, fb)).collect()
    assert [(r.value_break, r.total_transactions) for r in out] == [("0 and 10", 1)]


def test_empty_group_rate_is_null_not_error(make_tx):
    tx, fb = make_tx([tx_row(None, distance=10.0)])
    from riskbands.operators.bands import label_fraud
    out = E.distance_ladder(label_fraud(tx, fb)).collect()
    assert [(r.total_transactions, r.fraud_rate) for r in out] == [(0, None)]


def test_ladders_against_literal_edges():
    from riskbands.functions import ladders as L

    def edges(*stretches):
        return [(float(a), float(a + w)) for lo, hi, w in stretches for a in range(lo, hi, w)]

    assert list(L.DISTANCE_LADDER.bins) == edges((0, 100_000, 1_000), (100_000, 1_000_000, 100_000))
    assert list(L.VALUE_LADDER.bins) == edges((0, 1_000, 10), (1_000, 10_000, 1_000))
    assert list(L.AGE_LADDER.bins) == edges((0, 10, 1), (11, 496, 5)) + [(496.0, 500.0)] + edges((501, 581, 5))
    assert [len(s.bins) for s in (L.DISTANCE_LADDER, L.VALUE_LADDER, L.AGE_LADDER)] == [109, 109, 124]
    assert L.DISTANCE_LADDER.labels[0] == "0 and 1000" and L.DISTANCE_LADDER.labels[-2:] == ["> 1000km", "unknown"]
