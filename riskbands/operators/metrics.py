"""Current decision flow vs the banded flow: fraud cost, 2FA cost, revenue, approval,
false positives and false negatives.  Each metric is a one-row DataFrame.

A metric names the counts and sums that it needs (``COUNTS``, ``SUMS``) and its formulas over them. A single metric
reduces the rows for its own names; ``flow_report`` reduces them once for the union of all metrics' names (the
banded rows are labelled, so they hold the current flow too) and evaluates every formula on that one row.

``count(distinct case when cond then id end)`` is computed as: reduce to one row per id with
``max(cond)``, then ``sum`` over non-null ids.  Rows without an id need no reduction, so they are
kept apart (``Halves``): the labelling joins have partitioned the others by id, and the reduction
shuffles nothing.  Value sums are summed per id and then globally, which keeps the SQL null rule (no
matching row -> null).  No Expand, one global pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_cost, money, safe_div
from ..policy import DEFAULT, Policy
from .bands import ID, Halves, label_halves

VALUE = "transaction_value"


def _id_reduce(frame: DataFrame | Halves, counts: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """One global row: ``T`` = distinct non-null ids, each count = distinct ids meeting its
    condition, each sum = sum of ``transaction_value`` over rows meeting its condition."""
    known, unknown = Halves.of(frame)
    marks = [*[F.max(c.cast("int")).alias(k) for k, c in counts.items()],
             *[F.sum(F.when(c, F.col(VALUE))).alias(k) for k, c in sums.items()]]
    per_id = known.groupBy(ID).agg(*marks) if marks else known.select(ID).distinct()
    values = unknown.select(F.lit(None).cast("string").alias(ID), *[F.lit(None).cast("int").alias(k) for k in counts],
                            *[F.when(c, F.col(VALUE)).alias(k) for k, c in sums.items()])
    rows = per_id.unionByName(values) if sums else per_id
    return rows.agg(
        F.count(ID).alias("T"),
        *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in counts],
        *[F.sum(k).alias(k) for k in sums])


def _current(tx: DataFrame | Halves, feedback: DataFrame) -> Halves:
    """Transactions left-joined to feedback, with ``is_fraud``."""
    return label_halves(tx.select(ID, VALUE, "client_decision"), feedback)


def approved() -> Column:
    return F.col("client_decision") == "approved"


def denied() -> Column:
    return F.col("client_decision") == "denied"


def fraud() -> Column:
    return F.col("is_fraud") == 1


def legit() -> Column:
    return F.col("is_fraud") == 0


def band(name: str) -> Column:
    return F.col("risk_band") == name


def _accepted() -> Column:
    """What the banded flow lets pass: the low band, and what the current flow approved in the mid band."""
    return band("low") | (band("mid") & approved())


#: Distinct ids that meet a condition.
COUNTS: dict[str, Callable[[], Column]] = {
    "fraud": fraud, "ok": approved, "ok_fraud": lambda: approved() & fraud(), "ok_legit": lambda: approved() & legit(),
    "low_fraud": lambda: band("low") & fraud(), "mid_fraud": lambda: band("mid") & fraud(),
    "low_legit_denied": lambda: band("low") & legit() & denied(), "mid": lambda: band("mid"), "accepted": _accepted,
    "high_legit_ok": lambda: band("high") & legit() & approved(), "mid_legit_ok": lambda: band("mid") & legit() & approved(),
    "mid_fraud_ok": lambda: band("mid") & fraud() & approved()}
#: Sums of the transaction value over rows that meet a condition.
SUMS: dict[str, Callable[[], Column]] = {
    "v_fraud": fraud, "v_ok_legit": lambda: approved() & legit(), "v_low_fraud": lambda: band("low") & fraud(),
    "v_mid_fraud": lambda: band("mid") & fraud(), "v_low_legit_denied": lambda: band("low") & legit() & denied(),
    "v_accepted": _accepted, "v_accepted_fraud": lambda: _accepted() & fraud(),
    "v_mid_fraud_denied": lambda: band("mid") & fraud() & denied()}


class Metric(NamedTuple):
    """Names of :data:`COUNTS` and :data:`SUMS` that a metric needs, and its named formulas over them."""

    needs: tuple[str, ...]
    formulas: Callable[[Policy], dict[str, Column]]


def _rate(part: str | int) -> Column:
    return safe_div(F.col(part) if isinstance(part, str) else F.lit(part), F.col("T"))


def _paid(value: str, policy: Policy) -> Column:
    """The fee on a value, in cents; null where the value is null."""
    return money(F.col(value) * F.lit(float(policy.fee_rate)))


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _fraud_cost_current(p: Policy) -> dict[str, Column]:
    lost = _paid("v_fraud", p)
    return {"total_transactions": F.col("T"), "total_frauds": F.col("fraud"), "total_fraud_transaction": lost,
            "fraud_rate": safe_div(F.lit(100) * F.col("fraud"), F.col("T")),
            "total_fraud_cost": lost + exact_cost(F.col("fraud"), p.twofa_cost)}


def _fraud_cost_new(p: Policy) -> dict[str, Column]:
    fee = F.lit(float(p.fee_rate))
    frauds = F.col("low_fraud") + F.col("mid_fraud")
    lost = F.col("v_low_fraud") * fee + F.col("v_mid_fraud") * fee
    rate = safe_div(F.lit(100) * frauds, F.col("T"))
    cost = lost + exact_cost(F.col("mid_fraud"), p.twofa_cost)
    turned = (rate / F.lit(100)) * F.lit(p.new_fraud_value) * F.col("low_legit_denied") * fee
    return {"count_transactions": F.col("T"), "count_frauds": frauds, "total_frauds_low_band": F.col("v_low_fraud"),
            "count_low_band_denied": F.col("low_legit_denied"), "total_low_band_denied": F.col("v_low_legit_denied"),
            "total_frauds_mid_band": F.col("v_mid_fraud"), "count_frauds_mid_band": F.col("mid_fraud"),
            "total_fraud": lost, "fraud_rate": rate, "total_fraud_cost": cost,
            "total_fraud_cost_realistic_case": cost + turned}


def _revenue_current(p: Policy) -> dict[str, Column]:
    lost, earned = _paid("v_fraud", p), _paid("v_ok_legit", p)
    checks = (F.col("T").cast("decimal(20,0)") * F.lit(p.twofa_cost)).cast("double")
    return {"total_transactions": F.col("T"), "total_fraud_transaction": lost, "total_approved_transaction": earned,
            "total_revenue": _or_zero(earned) - _or_zero(lost) - _or_zero(checks)}


def _revenue_new(p: Policy) -> dict[str, Column]:
    def paid(value: str) -> Column:
        return money(_or_zero(F.col(value)) * F.lit(float(p.fee_rate)))

    revenue = (paid("v_accepted") - paid("v_accepted_fraud") - paid("v_mid_fraud_denied")
               - exact_cost(F.col("mid"), p.twofa_cost))
    turned = paid("v_low_legit_denied")
    return {"total_low_band_denied": F.col("v_low_legit_denied"), "count_mid_band": F.col("mid"),
            "total_approved": F.col("v_accepted"), "total_fraud_approved": F.col("v_accepted_fraud"),
            "total_fraud_denied": F.col("v_mid_fraud_denied"), "total_revenue": revenue,
            "total_approved_cost_if_all_fraudsters": turned, "worst_case_scenario": revenue - turned}


CURRENT: dict[str, Metric] = {
    "fraud_cost_current": Metric(("fraud", "v_fraud"), _fraud_cost_current),
    "twofa_cost_current": Metric((), lambda p: {
        "total_transactions": F.col("T"), "total_2fa_cost": exact_cost(F.col("T"), p.twofa_cost)}),
    "revenue_current": Metric(("v_fraud", "v_ok_legit"), _revenue_current),
    "approval_current": Metric(("ok",), lambda p: {
        "total_transactions": F.col("T"), "total_approvals": F.col("ok"), "total_approval_rate": _rate("ok")}),
    "false_positive_current": Metric(("ok_legit",), lambda p: {
        "total_transactions": F.col("T"), "hard_false_positives": F.lit(0), "hard_false_positive_rate": _rate(0),
        "soft_false_positives": F.col("ok_legit"), "soft_false_positive_rate": _rate("ok_legit")}),
    "false_negative_current": Metric(("ok_fraud",), lambda p: {
        "total_transactions": F.col("T"), "hard_false_negatives": F.lit(0), "hard_false_negative_rate": _rate(0),
        "soft_false_negative": F.col("ok_fraud"), "soft_false_negative_rate": _rate("ok_fraud")}),
}
NEW: dict[str, Metric] = {
    "fraud_cost_new": Metric(("low_fraud", "mid_fraud", "low_legit_denied", "v_low_fraud", "v_mid_fraud",
                              "v_low_legit_denied"), _fraud_cost_new),
    "twofa_cost_new": Metric(("mid",), lambda p: {
        "count_mid_band": F.col("mid"), "total_2fa_cost": exact_cost(F.col("mid"), p.twofa_cost)}),
    "revenue_new": Metric(("mid", "v_low_legit_denied", "v_accepted", "v_accepted_fraud", "v_mid_fraud_denied"), _revenue_new),
    "approval_new": Metric(("accepted",), lambda p: {
        "count_transactions": F.col("T"), "count_approved": F.col("accepted"), "total_approved": _rate("accepted")}),
    "false_positive_new": Metric(("high_legit_ok", "mid_legit_ok"), lambda p: {
        "total_transactions": F.col("T"), "hard_false_positives": F.col("high_legit_ok"),
        "soft_false_positives": F.col("mid_legit_ok"), "hard_false_positive_rate": _rate("high_legit_ok"),
        "soft_false_positive_rate": _rate("mid_legit_ok")}),
    "false_negative_new": Metric(("low_fraud", "mid_fraud_ok"), lambda p: {
        "total_transactions": F.col("T"), "hard_false_negative": F.col("low_fraud"),
        "soft_false_negative": F.col("mid_fraud_ok"), "hard_false_negative_rate": _rate("low_fraud"),
        "soft_false_negative_rate": _rate("mid_fraud_ok")}),
}
METRICS: dict[str, Metric] = {**CURRENT, **NEW}


def reduced(frame: DataFrame | Halves, names) -> DataFrame:
    """The one row of the named counts and sums, each reduced to ids once however many metrics need it."""
    names = dict.fromkeys(names)
    return _id_reduce(frame, {k: COUNTS[k]() for k in names if k in COUNTS}, {k: SUMS[k]() for k in names if k in SUMS})


def _one(frame: DataFrame | Halves, name: str, policy: Policy) -> DataFrame:
    metric = METRICS[name]
    return reduced(frame, metric.needs).select(*[c.alias(k) for k, c in metric.formulas(policy).items()])


def flow_report(bands: DataFrame | Halves, policy: Policy = DEFAULT, names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """(metric, measure, value) of several metrics of both flows, from one reduction of the banded rows."""
    row = reduced(bands, [n for m in names for n in METRICS[m].needs])
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("measure"), c.cast("double").alias("value"))
            for m in names for k, c in METRICS[m].formulas(policy).items()]
    return row.select(F.inline(F.array(*rows)))


def fraud_cost_current(tx: DataFrame | Halves, feedback: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return _one(_current(tx, feedback), "fraud_cost_current", policy)


def fraud_cost_new(bands: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    return _one(bands, "fraud_cost_new", policy)


def twofa_cost_current(tx: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    """Every transaction pays for a check: the label join is not needed."""
    return _one(tx.select(ID, VALUE), "twofa_cost_current", policy)


def twofa_cost_new(bands: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    return _one(bands, "twofa_cost_new", policy)


def revenue_current(tx: DataFrame | Halves, feedback: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return _one(_current(tx, feedback), "revenue_current", policy)


def revenue_new(bands: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    return _one(bands, "revenue_new", policy)


def approval_current(tx: DataFrame | Halves, feedback: DataFrame) -> DataFrame:
    return _one(_current(tx, feedback), "approval_current", DEFAULT)


def approval_new(bands: DataFrame | Halves) -> DataFrame:
    return _one(bands, "approval_new", DEFAULT)


def false_positive_current(tx: DataFrame | Halves, feedback: DataFrame) -> DataFrame:
    return _one(_current(tx, feedback), "false_positive_current", DEFAULT)


def false_positive_new(bands: DataFrame | Halves) -> DataFrame:
    return _one(bands, "false_positive_new", DEFAULT)


def false_negative_current(tx: DataFrame | Halves, feedback: DataFrame) -> DataFrame:
    return _one(_current(tx, feedback), "false_negative_current", DEFAULT)


def false_negative_new(bands: DataFrame | Halves) -> DataFrame:
    return _one(bands, "false_negative_new", DEFAULT)
