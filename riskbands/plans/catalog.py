"""Registry of every query: name -> callable(spark, sf_dir) -> DataFrame.

Each entry derives its inputs from the driver's ``events`` table (see sources.fixtures) and runs
one library operator over the whole table.  ``DECIMALS`` lists, per query, the inexact double
columns (means, deviations, correlations, interpolated quantiles, unrounded double sums) and the number
of decimals to which the query returns them (fewer from a million on); the oracle applies the same rounding.
Exact columns (counts, minima, maxima, whiskers) are returned as the operators give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import bands as B
from ..operators import evidence as E
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import stats as S
from ..operators.device_history import accounts_per_device_history, shared_device_tx
from ..policy import DEFAULT, Policy
from ..session import scratch_path
from ..sources import io as IO
from ..sources import versions as V
from ..sources.fixtures import load_tables
from .tables import DerivedTables, stored_features, stored_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
DECIMALS: dict[str, dict[str, int]] = {}

_DESCRIBE = ["mean", "std", "p25", "p50", "p75"]
_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]  # a whisker can sit on the box's edge
_HIST = ["bin_start", "bin_end"]


def query(name: str, inexact: list[str] | None = None, decimals: int = 4):
    def deco(fn: Callable[..., DataFrame]) -> QueryFn:
        places = {c: decimals for c in inexact or []}

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: rounded(F.col(c), d) for c, d in places.items()}) if places else df
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DECIMALS[name] = places
        return run
    return deco


def _tx(spark, sf):
    return load_tables(spark, sf)


def _bands(spark, sf, policy: Policy = DEFAULT):
    tx, fb = _tx(spark, sf)
    return B.risk_bands(tx, fb, policy)


def _base(spark, sf, policy: Policy = DEFAULT):
    tx, fb = _tx(spark, sf)
    return B.non_high_risk_base(tx, fb, policy)


def _stored(spark, sf) -> DerivedTables:
    """The saved tables: the analysis writes them once and its reports read them."""
    return stored_tables(spark, sf)


def _encoded(spark, sf):
    """The encoded rows, saved once: every statistic of the analysis reads that one frame."""
    return stored_features(spark, sf)


# ---------------------------------------------------------------- sources and sinks
@query("read_csv_inferred")
def _q_read_csv_inferred(spark, sf):
    """Feedback written as CSV, read back with header + inferred schema."""
    _, fb = _tx(spark, sf)
    path = IO.write_csv(fb, scratch_path(spark, "feedback-csv"))
    return IO.read_csv_inferred(spark, path)


@query("read_csv_schema")
def _q_read_csv_schema(spark, sf):
    """Transactions written as CSV, read back with the fixed schema."""
    tx, _ = _tx(spark, sf)
    path = IO.write_csv(tx, scratch_path(spark, "transactions-csv"))
    return IO.read_csv_schema(spark, path)


@query("save_table")
def _q_save_table(spark, sf):
    """Transactions saved as a Parquet catalog table and read from the catalog."""
    tx, _ = _tx(spark, sf)
    name = IO.save_table(spark, tx, IO.unique_table_name("transactions"))
    return IO.read_table(spark, name)


@query("overwrite_table")
def _q_overwrite_table(spark, sf):
    """The high band saved as a table once; a banded table created, then overwritten with
    the bands computed from the saved high band, and read back."""
    tx, fb = _tx(spark, sf)
    high = IO.save_table(spark, B.high_risk_band(tx), IO.unique_table_name("high_risk_band"))
    name = IO.save_table(spark, B.label_fraud(tx, fb), IO.unique_table_name("transactions_with_bands"))
    IO.overwrite_table(spark, B.risk_bands(tx, fb, high=IO.read_table(spark, high)), name)
    IO.drop_table(spark, high)
    return IO.read_table(spark, name)


@query("versioned_table")
def _q_versioned(spark, sf):
    """A versioned table: the labelled rows, replaced by the banded ones (another schema), and its newest version."""
    root = scratch_path(spark, "versioned-transactions")
    t = _stored(spark, sf)
    V.publish(spark, B.label_halves(t.transactions, t.feedback).whole(), root)
    V.publish(spark, t.transactions_with_bands, root)
    V.vacuum(spark, root)
    return V.read(spark, root)


@query("scan_parquet")
def _q_scan_parquet(spark, sf):
    """Both tables written as Parquet, scanned by path and left-joined (is_fraud 1 or null)."""
    tx, fb = _tx(spark, sf)
    t = IO.scan_parquet(spark, IO.write_parquet(tx, scratch_path(spark, "transactions-parquet")))
    f = IO.scan_parquet(spark, IO.write_parquet(fb, scratch_path(spark, "feedback-parquet")))
    return t.join(f.withColumn("is_fraud", F.lit(1)), on="transaction_id", how="left")


# ---------------------------------------------------------------- statistics
@query("encode_features")
def _q_encode(spark, sf):
    tx, fb = _tx(spark, sf)
    return P.encode_features(tx, fb)


@query("null_counts")
def _q_null_counts(spark, sf):
    return P.null_counts(_encoded(spark, sf))


@query("describe_all", _DESCRIBE)
def _q_describe_all(spark, sf):
    return S.describe(_encoded(spark, sf))


@query("describe_clean", _DESCRIBE)
def _q_describe_clean(spark, sf):
    return S.describe(S.clean(_encoded(spark, sf)), P.CLEAN_COLUMNS)


@query("profile_quantiles", P.CLEAN_COLUMNS)
def _q_quantiles(spark, sf):
    return S.quantile_table(S.clean(_encoded(spark, sf)))


@query("boxplot_all", _BOX)
def _q_box_all(spark, sf):
    return S.box_stats(_encoded(spark, sf))


@query("boxplot_fraud", _BOX)
def _q_box_fraud(spark, sf):
    return S.box_stats(_encoded(spark, sf).where(F.col("is_fraud") == 1))


@query("boxplot_good", _BOX)
def _q_box_good(spark, sf):
    return S.box_stats(_encoded(spark, sf).where(F.col("is_fraud") == 0))


@query("histogram_value", _HIST)
def _q_hist_value(spark, sf):
    """Transaction values with |z| < 3, numpy "auto" bins."""
    c, enc = "transaction_value", _encoded(spark, sf)
    kept = S.zscore_filter(enc, c, DEFAULT.zscore_cut, S.moments(enc, c))
    return S.histogram(kept, c, at=S.histogram_grid(kept, c, DEFAULT.value_hist_bins))


@query("histogram_distance", _HIST)
def _q_hist_distance(spark, sf):
    """Complete rows, |z(distance)| < 3, distances >= 100 masked to null, 500 bins."""
    c = "distance_to_frequent_location"
    masked = _masked_distances(spark, sf)
    return S.histogram(masked, c, at=S.histogram_grid(masked, c, DEFAULT.distance_hist_bins))


def _masked_distances(spark, sf):
    c, rows = "distance_to_frequent_location", S.clean(_encoded(spark, sf))
    kept = S.zscore_filter(rows, c, DEFAULT.zscore_cut, S.moments(rows, c))
    return S.mask(kept, F.col(c) < DEFAULT.distance_plot_cut)


@query("masked_distances")
def _q_masked(spark, sf):
    """The rows of the distance plot: those at 100 or farther keep their place and lose their values."""
    return _masked_distances(spark, sf)


@query("correlation_matrix", ["r"])
def _q_corr(spark, sf):
    return S.correlation_matrix(_encoded(spark, sf))


@query("zscore_filter")
def _q_zscore(spark, sf):
    c, enc = "transaction_value", _encoded(spark, sf)
    return S.zscore_filter(enc, c, DEFAULT.zscore_cut, S.moments(enc, c))


# ---------------------------------------------------------------- profiles
@query("tx_by_device_age")
def _q_age(spark, sf):
    return P.tx_by_device_age(_tx(spark, sf)[0])


@query("tx_by_hour")
def _q_hour(spark, sf):
    return P.tx_by_hour(_tx(spark, sf)[0])


@query("tx_by_decision")
def _q_decision(spark, sf):
    return P.tx_by_decision(_tx(spark, sf)[0])


@query("flag_profile")
def _q_flags(spark, sf):
    return P.flag_profile(_tx(spark, sf)[0])


@query("devices_per_account")
def _q_dpa(spark, sf):
    return P.devices_per_account(_tx(spark, sf)[0])


@query("accounts_per_device")
def _q_apd(spark, sf):
    return P.accounts_per_device(_tx(spark, sf)[0])


# ---------------------------------------------------------------- history and bands
@query("accounts_per_device_history")
def _q_history(spark, sf):
    return accounts_per_device_history(_tx(spark, sf)[0])


@query("shared_device_tx")
def _q_shared(spark, sf):
    return shared_device_tx(_tx(spark, sf)[0])


@query("rule_any_flag")
def _q_rule_flag(spark, sf):
    return B.rule_any_flag(_tx(spark, sf)[0])


@query("rule_far_distance")
def _q_rule_far(spark, sf):
    return B.rule_far_distance(_stored(spark, sf).by_distance)


@query("high_risk_band")
def _q_high(spark, sf):
    return B.high_risk_band(_tx(spark, sf)[0])


@query("medium_low_band")
def _q_medium_low(spark, sf):
    tx, fb = _tx(spark, sf)
    return B.medium_low_band(tx, fb)


@query("label_fraud")
def _q_label(spark, sf):
    """Stated as SQL text (spark.sql), as the analysis does for this step."""
    tx, fb = _tx(spark, sf)
    return B.label_fraud_sql(spark, tx, fb)


@query("risk_bands")
def _q_bands(spark, sf):
    return _bands(spark, sf)


@query("band_counts")
def _q_band_counts(spark, sf):
    return B.band_counts(_bands(spark, sf))


@query("non_high_risk_base")
def _q_base(spark, sf):
    return _base(spark, sf)


# ---------------------------------------------------------------- evidence
@query("distance_ladder")
def _q_dist_ladder(spark, sf):
    return E.distance_ladder(_stored(spark, sf).transactions_without_high_risk)


@query("value_ladder")
def _q_value_ladder(spark, sf):
    return E.value_ladder(_stored(spark, sf).transactions_without_high_risk)


@query("age_ladder")
def _q_age_ladder(spark, sf):
    return E.age_ladder(_stored(spark, sf).transactions_without_high_risk)


@query("fraud_by_device_age")
def _q_fraud_age(spark, sf):
    return E.fraud_by_device_age(_stored(spark, sf).transactions_without_high_risk)


@query("fraud_by_hour")
def _q_fraud_hour(spark, sf):
    return E.fraud_by_hour(_stored(spark, sf).transactions_without_high_risk)


@query("flag_fraud_share")
def _q_flag_share(spark, sf):
    tx, fb = _tx(spark, sf)
    return E.flag_fraud_share(tx, fb)


@query("fraud_by_device_accounts")
def _q_fraud_accounts(spark, sf):
    tx, fb = _tx(spark, sf)
    return E.fraud_by_device_accounts(tx, fb)


# ---------------------------------------------------------------- current vs new flow
@query("fraud_cost_current")
def _q_m1(spark, sf):
    t = _stored(spark, sf)
    return M.fraud_cost_current(t.transactions, t.feedback)


@query("fraud_cost_new", ["total_frauds_low_band", "total_low_band_denied", "total_frauds_mid_band",
                          "total_fraud", "total_fraud_cost", "total_fraud_cost_realistic_case"])
def _q_m2(spark, sf):
    return M.fraud_cost_new(_stored(spark, sf).banded)


@query("twofa_cost_current")
def _q_m3(spark, sf):
    return M.twofa_cost_current(_stored(spark, sf).transactions)


@query("twofa_cost_new")
def _q_m4(spark, sf):
    return M.twofa_cost_new(_stored(spark, sf).banded)


@query("revenue_current")
def _q_m5(spark, sf):
    t = _stored(spark, sf)
    return M.revenue_current(t.transactions, t.feedback)


@query("revenue_new", ["total_low_band_denied", "total_approved", "total_fraud_approved",
                       "total_fraud_denied"])
def _q_m6(spark, sf):
    return M.revenue_new(_stored(spark, sf).banded)


@query("approval_current")
def _q_m7(spark, sf):
    t = _stored(spark, sf)
    return M.approval_current(t.transactions, t.feedback)


@query("approval_new")
def _q_m8(spark, sf):
    return M.approval_new(_stored(spark, sf).banded)


@query("false_positive_current")
def _q_m9(spark, sf):
    t = _stored(spark, sf)
    return M.false_positive_current(t.transactions, t.feedback)


@query("false_positive_new")
def _q_m10(spark, sf):
    return M.false_positive_new(_stored(spark, sf).banded)


@query("false_negative_current")
def _q_m11(spark, sf):
    t = _stored(spark, sf)
    return M.false_negative_current(t.transactions, t.feedback)


@query("false_negative_new")
def _q_m12(spark, sf):
    return M.false_negative_new(_stored(spark, sf).banded)


# ---------------------------------------------------------------- reports over the saved tables
#: Measures of :func:`flow_report` that are returned rounded, as the single metrics return them.
FLOW_DECIMALS = {(m, c): d for m in M.METRICS for c, d in DECIMALS[m].items()}


@query("flow_report")
def _q_flow_report(spark, sf):
    """All twelve metrics of both flows from one reduction of the banded rows: (metric, measure, value)."""
    rows = M.flow_report(_stored(spark, sf).banded)
    inexact = F.concat_ws(".", "metric", "measure").isin([f"{m}.{c}" for m, c in FLOW_DECIMALS])
    return rows.withColumn("value", F.when(inexact, rounded(F.col("value"), 4)).otherwise(F.col("value")))


@query("evidence_report")
def _q_evidence_report(spark, sf):
    """The three ladders and the rates by age and hour from one scan of the base."""
    return E.evidence_report(_stored(spark, sf).base)
