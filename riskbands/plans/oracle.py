"""DuckDB SQL for every registered query: the independent oracle.

Stated from the formulas, by other algorithms than the engine's: accounts so far are counted from each
account's first sighting on a device, bands are set membership over ids grouped with their reasons, ladders
place a value in the least matching bin of a generated edge table, and the metrics are rendered from one
declarative table (``METRICS``: conditions whose distinct ids are counted and whose values are summed over the rows
as they are, without the engine's reduction to ids, and output formulas).  Inexact doubles
(``catalog.DECIMALS``) are rounded to decimals on both sides; everything else is compared as it is.
"""

from __future__ import annotations

from ..operators.profile import CLEAN_COLUMNS, NUMERIC_COLUMNS
from ..policy import DEFAULT
from ..sources.fixtures import feedback_sql, transactions_sql
from ..sources.schema import FLAG_COLUMNS

P = DEFAULT
ANY_FLAG = "(" + " OR ".join(f"coalesce({f}, false)" for f in FLAG_COLUMNS) + ")"
NO_FLAG_NULL = " AND ".join(f"{f} IS NOT NULL" for f in FLAG_COLUMNS)
FLAGS_TRUE = " OR ".join(f"{f} = true" for f in ["has_fake_location", "is_emulator",
                                                  "has_root_permissions", "app_is_tampered"])


def money(expr: str) -> str:
    return f"CAST(ROUND(TRY_CAST(({expr}) AS DECIMAL(38,6)), 2) AS DOUBLE)"


def cost(count_expr: str) -> str:
    return f"CAST(ROUND(CAST(({count_expr}) AS DECIMAL(20,0)) * {P.twofa_cost}, 2) AS DOUBLE)"


CTES = {
    "transactions": transactions_sql("duckdb"),
    "transactions_fraud_feedback": feedback_sql("duckdb"),
    "first_seen": """
      SELECT device_id, account_id, min(transaction_timestamp) AS since
      FROM transactions WHERE account_id IS NOT NULL GROUP BY ALL""",
    # accounts whose first sighting on the device is not after the transaction
    "devs": """
      SELECT account_id, transaction_id, device_id, transaction_timestamp,
             (SELECT count(*) FROM first_seen s
              WHERE s.device_id = g.device_id AND s.since <= g.transaction_timestamp) AS total_accounts
      FROM (SELECT DISTINCT account_id, transaction_id, device_id, transaction_timestamp FROM transactions
            WHERE device_id IS NOT NULL AND transaction_timestamp IS NOT NULL) g""",
    "hrb": f"""
      SELECT transaction_id
      FROM (SELECT transaction_id, {ANY_FLAG} OR coalesce(distance_to_frequent_location > {P.far_distance}, false) AS hit
            FROM transactions
            UNION ALL SELECT transaction_id, total_accounts >= {P.shared_device_accounts} FROM devs)
      GROUP BY transaction_id HAVING bool_or(hit)""",
    "not_base": f"""
      SELECT transaction_id
      FROM (SELECT transaction_id, {ANY_FLAG} AS hit FROM transactions
            UNION ALL SELECT transaction_id, total_accounts >= {P.shared_device_accounts} FROM devs)
      GROUP BY transaction_id HAVING bool_or(hit) AND transaction_id IS NOT NULL""",
    "labelled": """
      SELECT t.*, CASE WHEN tff.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS is_fraud
      FROM transactions t
      LEFT JOIN transactions_fraud_feedback tff ON t.transaction_id = tff.transaction_id""",
    "bands": f"""
      SELECT l.* EXCLUDE (low, high), CASE WHEN high THEN 'high' WHEN low THEN 'low' ELSE 'mid' END AS risk_band
      FROM (SELECT l.*, coalesce(transaction_id IN (SELECT transaction_id FROM hrb WHERE transaction_id IS NOT NULL), false) AS high,
                   coalesce(transaction_value < {P.low_max_value} AND distance_to_frequent_location < {P.low_max_distance}
                            AND device_age_days > {P.low_min_device_age} AND {NO_FLAG_NULL}, false) AS low
            FROM labelled l) l""",
    "nhr": """
      SELECT * FROM labelled
      WHERE transaction_id IS NULL OR transaction_id NOT IN (SELECT transaction_id FROM not_base)""",
    "enc": f"""
      SELECT t.transaction_id, t.transaction_timestamp, t.account_id, t.device_id,
             t.distance_to_frequent_location, t.device_age_days,
             {", ".join(f"CAST(t.{f} AS INTEGER) AS {f}" for f in FLAG_COLUMNS)},
             t.transaction_value,
             CASE WHEN t.client_decision = 'approved' THEN 1
                  WHEN t.client_decision = 'denied' THEN 0 END AS client_decision,
             CASE WHEN tff.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS is_fraud,
             epoch_ms(t.transaction_timestamp) AS transaction_ts
      FROM transactions t
      LEFT JOIN transactions_fraud_feedback tff ON t.transaction_id = tff.transaction_id""",
    "clean": "SELECT * FROM enc WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CLEAN_COLUMNS),
}
_ORDER = list(CTES)
_DEPS = {"devs": ["first_seen"], "hrb": ["devs"], "not_base": ["devs"], "bands": ["labelled", "hrb"],
         "nhr": ["labelled", "not_base"], "clean": ["enc"]}


def _with(names: list[str], body: str) -> str:
    need: set[str] = {"transactions", "transactions_fraud_feedback"}
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack += _DEPS.get(n, [])
    parts = [f"{n} AS ({CTES[n]})" for n in _ORDER if n in need]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------------------ statistics
def _describe(frame: str, cols) -> str:
    sel = []
    for c in cols:
        sel.append(f"""SELECT '{c}' AS column_name, count(x) AS count, avg(x) AS mean,
          stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS p25,
          quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
          FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {frame})""")
    return "\nUNION ALL\n".join(sel)


def _quantiles(frame: str) -> str:
    sel = []
    for p in P.quantiles:
        cols = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}" for c in CLEAN_COLUMNS)
        sel.append(f"SELECT CAST({p} AS DOUBLE) AS quantile, {cols} FROM {frame}")
    return "\nUNION ALL\n".join(sel)


def _box(where: str) -> str:
    sel = []
    for c in ["transaction_value", "distance_to_frequent_location", "device_age_days"]:
        src = f"(SELECT CAST({c} AS DOUBLE) AS x FROM enc WHERE {where})"
        q = lambda p: f"(SELECT quantile_cont(x, {p}) FROM {src})"
        q1, med, q3 = q(0.25), q(0.5), q(0.75)
        lo, hi = f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"
        wlo, whi = f"min(CASE WHEN x >= {lo} THEN x END)", f"max(CASE WHEN x <= {hi} THEN x END)"
        sel.append(f"""SELECT '{c}' AS column_name, count(x) AS count, {q1} AS q1, {med} AS median,
          {q3} AS q3,
          CASE WHEN {wlo} IS NULL OR {wlo} > {q1} THEN {q1} ELSE {wlo} END AS whisker_low,
          CASE WHEN {whi} IS NULL OR {whi} < {q3} THEN {q3} ELSE {whi} END AS whisker_high,
          count(CASE WHEN x < {lo} OR x > {hi} THEN x END) AS outliers
          FROM {src}""")
    return "\nUNION ALL\n".join(sel)


def _zscore(frame: str, c: str) -> str:
    return (f"SELECT * FROM {frame} WHERE abs(({c} - (SELECT avg({c}) FROM {frame}))"
            f" / (SELECT stddev_pop({c}) FROM {frame})) < {P.zscore_cut}")


def _histogram(frame_sql: str, c: str, bins) -> str:
    if bins == "auto":
        nb = """CASE WHEN (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) > 0
                 THEN CAST(ceil(ptp / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS INTEGER)
                 ELSE 1 END"""
    else:
        nb = str(int(bins))
    return f"""
    vals AS (SELECT CAST({c} AS DOUBLE) AS x FROM ({frame_sql}) WHERE {c} IS NOT NULL),
    st AS (SELECT count(x) AS n, min(x) AS mn, max(x) AS mx,
                  quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM vals),
    st2 AS (SELECT *, mx - mn AS ptp, (mx - mn) / (log2(CAST(n AS DOUBLE)) + 1.0) AS sturges,
                  2.0 * (q75 - q25) * pow(CAST(n AS DOUBLE), -1.0 / 3.0) AS fd FROM st),
    sp AS (SELECT n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                  CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, {nb} AS nb FROM st2),
    i0 AS (SELECT x, lo, hi, nb,
                  CAST(least(floor((x - lo) * (nb / (hi - lo))), nb - 1) AS INTEGER) AS i0
           FROM vals, sp),
    idx AS (SELECT CASE WHEN x < lo + i0 * ((hi - lo) / nb) THEN i0 - 1
                        WHEN x >= (CASE WHEN i0 + 1 = nb THEN hi ELSE lo + (i0 + 1) * ((hi - lo) / nb) END)
                             AND i0 <> nb - 1 THEN i0 + 1
                        ELSE i0 END AS bin FROM i0),
    counts AS (SELECT bin, count(*) AS count FROM idx GROUP BY bin),
    grid AS (SELECT CAST(unnest(range(nb)) AS INTEGER) AS bin, lo, hi, nb FROM sp WHERE n > 0)
    SELECT g.bin, g.lo + g.bin * ((g.hi - g.lo) / g.nb) AS bin_start,
           CASE WHEN g.bin + 1 = g.nb THEN g.hi ELSE g.lo + (g.bin + 1) * ((g.hi - g.lo) / g.nb) END AS bin_end,
           coalesce(c.count, 0) AS count
    FROM grid g LEFT JOIN counts c ON g.bin = c.bin"""


def _corr() -> str:
    cols = NUMERIC_COLUMNS
    exprs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            exprs.append(
                f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
                f" * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS {a}__{b}")
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"{a}__{b}" if i <= j else f"{b}__{a}"
            rows.append(f"SELECT '{a}' AS x, '{b}' AS y, {k} AS r FROM cm")
    return (f", cm AS (SELECT {', '.join(exprs)} FROM (SELECT {cast} FROM enc))\n"
            + "\nUNION ALL\n".join(rows))


# ------------------------------------------------------------------ ladders
# Column, label column, (first edge, last edge, width) of each stretch, label above the last edge.
_LADDERS = {
    "distance_ladder": ("distance_to_frequent_location", "distance_break",
                        [(0, 100000, 1000), (100000, 1000000, 100000)], "> 1000km"),
    "value_ladder": ("transaction_value", "value_break", [(0, 1000, 10), (1000, 10000, 1000)], "> 10000"),
    "age_ladder": ("device_age_days", "age_break", [(0, 10, 1), (11, 496, 5), (496, 500, 4), (501, 581, 5)], "> 581"),
}


def _ladder(name: str, where: str = "true") -> str:
    column, label, stretches, top = _LADDERS[name]
    edges = " UNION ALL ".join(f"SELECT range AS lo, range + {w} AS hi FROM range({a}, {b}, {w})" for a, b, w in stretches)
    return f""",
    bins AS (SELECT row_number() OVER (ORDER BY lo) AS r, lo, hi FROM ({edges})),
    placed AS (SELECT transaction_id, is_fraud,
                      CASE WHEN n.{column} > (SELECT max(hi) FROM bins) THEN (SELECT count(*) + 1 FROM bins)
                           ELSE coalesce((SELECT min(r) FROM bins WHERE n.{column} >= lo AND n.{column} <= hi),
                                         (SELECT count(*) + 2 FROM bins)) END AS place
               FROM nhr n WHERE {where})
    SELECT CASE WHEN any_value(lo) IS NOT NULL THEN concat(any_value(lo), ' and ', any_value(hi))
                WHEN place = (SELECT count(*) + 1 FROM bins) THEN '{top}' ELSE 'unknown' END AS {label},
           CAST(place AS INTEGER) AS bin_rank,
           count(DISTINCT transaction_id) AS total_transactions, CAST(sum(is_fraud) AS BIGINT) AS total_frauds,
           100 * CAST(sum(is_fraud) AS BIGINT) / nullif(count(DISTINCT transaction_id), 0) AS fraud_rate
    FROM placed LEFT JOIN bins ON r = place GROUP BY place"""


# ------------------------------------------------------------------ the metrics
# ``ids`` counts the distinct ids of the rows that meet a condition, ``sums`` adds those rows' values, ``out`` are formulas
# over these and ``n``, the number of ids.
_FLOWS = {
    "current": ("labelled", {"fb": "is_fraud = 1"}),
    "banded": ("bands", {"fb": "is_fraud = 1", "low": "risk_band = 'low'", "mid": "risk_band = 'mid'", "high": "risk_band = 'high'"}),
}
_YES, _NO = "client_decision = 'approved'", "client_decision = 'denied'"
FEE = P.fee_rate


def _share(part: str, times: int = 1) -> str:
    return f"{times} * ({part}) / nullif(n, 0)" if times != 1 else f"({part}) / nullif(n, 0)"


def _fee(value: str) -> str:
    return money(f"coalesce({value}, 0) * {FEE}")


_LOST = f"(low_lost * {FEE} + mid_lost * {FEE})"
_REVENUE = f"({_fee('ok')} - {_fee('fraud_ok')} - {_fee('fraud_no')} - {cost('mid_ids')})"
_COST = f"({_LOST} + {cost('mid_frauds')})"
METRICS: dict[str, tuple[str, dict[str, str], dict[str, str], dict[str, str]]] = {
    "fraud_cost_current": ("current", {"frauds": "fb"}, {"lost": "fb"}, {
        "total_transactions": "n", "total_frauds": "frauds", "total_fraud_transaction": money(f"lost * {FEE}"),
        "fraud_rate": _share("frauds", 100), "total_fraud_cost": f"{money(f'lost * {FEE}')} + {cost('frauds')}"}),
    "fraud_cost_new": ("banded", {"low_frauds": "fb AND low", "mid_frauds": "fb AND mid", "turned": f"NOT fb AND low AND {_NO}"},
                       {"low_lost": "fb AND low", "mid_lost": "fb AND mid", "turned_value": f"NOT fb AND low AND {_NO}"}, {
        "count_transactions": "n", "count_frauds": "low_frauds + mid_frauds", "total_frauds_low_band": "low_lost",
        "count_low_band_denied": "turned", "total_low_band_denied": "turned_value", "total_frauds_mid_band": "mid_lost",
        "count_frauds_mid_band": "mid_frauds", "total_fraud": _LOST, "fraud_rate": _share("low_frauds + mid_frauds", 100),
        "total_fraud_cost": _COST, "total_fraud_cost_realistic_case":
            f"{_COST} + {_share('low_frauds + mid_frauds')} * {P.new_fraud_value} * turned * {FEE}"}),
    "twofa_cost_current": ("current", {}, {}, {"total_transactions": "n", "total_2fa_cost": cost("n")}),
    "twofa_cost_new": ("banded", {"mid_ids": "mid"}, {}, {"count_mid_band": "mid_ids", "total_2fa_cost": cost("mid_ids")}),
    "revenue_current": ("current", {}, {"lost": "fb", "ok": f"{_YES} AND NOT fb"}, {
        "total_transactions": "n", "total_fraud_transaction": money(f"lost * {FEE}"),
        "total_approved_transaction": money(f"ok * {FEE}"),
        "total_revenue": f"{_fee('ok')} - {_fee('lost')} - CAST({P.twofa_cost} * n AS DOUBLE)"}),
    "revenue_new": ("banded", {"mid_ids": "mid"}, {
        "turned_value": f"NOT fb AND low AND {_NO}", "ok": f"low OR (mid AND {_YES})",
        "fraud_ok": f"fb AND (low OR (mid AND {_YES}))", "fraud_no": f"fb AND mid AND {_NO}"}, {
        "total_low_band_denied": "turned_value", "count_mid_band": "mid_ids", "total_approved": "ok",
        "total_fraud_approved": "fraud_ok", "total_fraud_denied": "fraud_no", "total_revenue": _REVENUE,
        "total_approved_cost_if_all_fraudsters": _fee("turned_value"), "worst_case_scenario": f"{_REVENUE} - {_fee('turned_value')}"}),
    "approval_current": ("current", {"yes": _YES}, {}, {
        "total_transactions": "n", "total_approvals": "yes", "total_approval_rate": _share("yes")}),
    "approval_new": ("banded", {"yes": f"low OR (mid AND {_YES})"}, {}, {
        "count_transactions": "n", "count_approved": "yes", "total_approved": _share("yes")}),
    "false_positive_current": ("current", {"soft": f"{_YES} AND NOT fb"}, {}, {
        "total_transactions": "n", "hard_false_positives": "0", "hard_false_positive_rate": _share("0"),
        "soft_false_positives": "soft", "soft_false_positive_rate": _share("soft")}),
    "false_positive_new": ("banded", {"hard": f"high AND NOT fb AND {_YES}", "soft": f"mid AND NOT fb AND {_YES}"}, {}, {
        "total_transactions": "n", "hard_false_positives": "hard", "soft_false_positives": "soft",
        "hard_false_positive_rate": _share("hard"), "soft_false_positive_rate": _share("soft")}),
    "false_negative_current": ("current", {"soft": f"fb AND {_YES}"}, {}, {
        "total_transactions": "n", "hard_false_negatives": "0", "hard_false_negative_rate": _share("0"),
        "soft_false_negative": "soft", "soft_false_negative_rate": _share("soft")}),
    "false_negative_new": ("banded", {"hard": "low AND fb", "soft": f"mid AND fb AND {_YES}"}, {}, {
        "total_transactions": "n", "hard_false_negative": "hard", "soft_false_negative": "soft",
        "hard_false_negative_rate": _share("hard"), "soft_false_negative_rate": _share("soft")}),
}


def _metric(name: str) -> str:
    flow, ids, sums, out = METRICS[name]
    source, marks = _FLOWS[flow]
    total = "".join([*(f", count(DISTINCT transaction_id) FILTER (WHERE {c}) AS {k}" for k, c in ids.items()),
                     *(f", sum(transaction_value) FILTER (WHERE {c}) AS {k}" for k, c in sums.items())])
    marked = ", ".join(f"{c} AS {k}" for k, c in marks.items())
    return _with([source], f"""SELECT {", ".join(f"{f} AS {k}" for k, f in out.items())}
      FROM (SELECT count(DISTINCT transaction_id) AS n{total} FROM (SELECT *, {marked} FROM {source}))""")


# ------------------------------------------------------------------ the queries
def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["read_csv_inferred"] = _with([], "SELECT transaction_id FROM transactions_fraud_feedback")
    q["read_csv_schema"] = _with([], "SELECT * FROM transactions")
    q["save_table"] = _with([], "SELECT * FROM transactions")
    q["overwrite_table"] = _with(["bands"], "SELECT * FROM bands")
    q["versioned_table"] = _with(["bands"], "SELECT * FROM bands")
    q["scan_parquet"] = _with([], """SELECT t.*, f.is_fraud FROM transactions t
        LEFT JOIN (SELECT transaction_id, 1 AS is_fraud FROM transactions_fraud_feedback) f
        ON t.transaction_id = f.transaction_id""")

    q["encode_features"] = _with(["enc"], "SELECT * FROM enc")
    enc_cols = ["transaction_id", "transaction_timestamp", "account_id", "device_id",
                "distance_to_frequent_location", "device_age_days", *FLAG_COLUMNS,
                "transaction_value", "client_decision", "is_fraud", "transaction_ts"]
    q["null_counts"] = _with(["enc"], "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM enc"
        for c in enc_cols))
    q["describe_all"] = _with(["enc"], _describe("enc", NUMERIC_COLUMNS))
    q["describe_clean"] = _with(["clean"], _describe("clean", CLEAN_COLUMNS))
    q["profile_quantiles"] = _with(["clean"], _quantiles("clean"))
    q["boxplot_all"] = _with(["enc"], _box("true"))
    q["boxplot_fraud"] = _with(["enc"], _box("is_fraud = 1"))
    q["boxplot_good"] = _with(["enc"], _box("is_fraud = 0"))
    value_frame = _zscore("enc", "transaction_value")
    q["histogram_value"] = _with(["enc"], "").rstrip() + "," + _histogram(
        value_frame, "transaction_value", P.value_hist_bins)
    dist_frame = (f"SELECT * FROM ({_zscore('clean', 'distance_to_frequent_location')})"
                  f" WHERE distance_to_frequent_location < {P.distance_plot_cut}")
    q["histogram_distance"] = _with(["clean"], "").rstrip() + "," + _histogram(
        dist_frame, "distance_to_frequent_location", P.distance_hist_bins)
    q["correlation_matrix"] = _with(["enc"], "").rstrip() + _corr()
    q["zscore_filter"] = _with(["enc"], _zscore("enc", "transaction_value"))

    q["tx_by_device_age"] = _with([], """SELECT device_age_days,
        count(DISTINCT transaction_id) AS total_transactions FROM transactions GROUP BY 1""")
    q["tx_by_hour"] = _with([], """SELECT CAST(hour(epoch_ms(transaction_timestamp)) AS INTEGER) AS ts_hour,
        count(transaction_id) AS total_transactions FROM transactions GROUP BY 1""")
    q["tx_by_decision"] = _with([], """SELECT client_decision, count(transaction_id) AS total_transactions
        FROM transactions GROUP BY 1""")
    flags = ", ".join(FLAG_COLUMNS)
    q["flag_profile"] = _with([], f"""
        SELECT column_name,
               count(transaction_id) FILTER (WHERE flag) AS total_true,
               count(transaction_id) FILTER (WHERE flag IS NULL) AS total_nulls
        FROM (SELECT transaction_id, {flags} FROM transactions)
             UNPIVOT INCLUDE NULLS (flag FOR column_name IN ({flags}))
        WHERE flag OR flag IS NULL
        GROUP BY column_name""")
    q["devices_per_account"] = _with([], """SELECT account_id, count(DISTINCT device_id) AS total_devices
        FROM transactions GROUP BY 1""")
    q["accounts_per_device"] = _with([], """SELECT device_id, count(DISTINCT account_id) AS total_accounts
        FROM transactions GROUP BY 1""")

    q["accounts_per_device_history"] = _with(["devs"], "SELECT * FROM devs")
    q["shared_device_tx"] = _with(["devs"], f"""SELECT transaction_id FROM devs
        WHERE total_accounts >= {P.shared_device_accounts}""")
    q["rule_any_flag"] = _with([], f"SELECT transaction_id FROM transactions WHERE {FLAGS_TRUE}")
    q["rule_far_distance"] = _with([], f"""SELECT transaction_id FROM transactions
        WHERE distance_to_frequent_location > {P.far_distance}""")
    q["high_risk_band"] = _with(["hrb"], "SELECT transaction_id FROM hrb")
    q["medium_low_band"] = _with(["bands"], f"""SELECT * EXCLUDE (risk_band),
        CAST(NOT (distance_to_frequent_location IS NOT NULL AND {NO_FLAG_NULL}) AS INTEGER) AS has_null_value
        FROM bands WHERE risk_band <> 'high'""")
    q["label_fraud"] = _with(["labelled"], "SELECT * FROM labelled")
    q["risk_bands"] = _with(["bands"], "SELECT * FROM bands")
    q["band_counts"] = _with(["bands"], """SELECT risk_band, count(transaction_id) AS total_transactions
        FROM bands GROUP BY 1""")
    q["non_high_risk_base"] = _with(["nhr"], "SELECT * FROM nhr")

    q["distance_ladder"] = _with(["nhr"], "").rstrip() + _ladder("distance_ladder")
    q["value_ladder"] = _with(["nhr"], "").rstrip() + _ladder(
        "value_ladder", f"distance_to_frequent_location < {P.value_ladder_max_distance}")
    q["age_ladder"] = _with(["nhr"], "").rstrip() + _ladder("age_ladder")
    q["fraud_by_device_age"] = _with(["nhr"], """SELECT device_age_days,
        CAST(sum(is_fraud) AS BIGINT) AS total_is_fraud,
        count(DISTINCT transaction_id) AS total_transactions,
        100 * CAST(sum(is_fraud) AS BIGINT) / nullif(count(DISTINCT transaction_id), 0) AS fraud_rating
        FROM nhr GROUP BY 1""")
    q["fraud_by_hour"] = _with(["nhr"], """SELECT CAST(hour(epoch_ms(transaction_timestamp)) AS INTEGER) AS ts_hour,
        count(transaction_id) AS total_transactions,
        CAST(sum(is_fraud) AS BIGINT) / nullif(count(transaction_id), 0) AS fraud_rate
        FROM nhr GROUP BY 1""")
    q["flag_fraud_share"] = _with(["labelled"], f"""
        SELECT n_fraud / nullif(n, 0) AS total_frauds, n_legit / nullif(n, 0) AS total_no_frauds
        FROM (SELECT count(transaction_id) AS n,
                     count(transaction_id) FILTER (WHERE is_fraud = 1) AS n_fraud,
                     count(transaction_id) FILTER (WHERE is_fraud = 0) AS n_legit
              FROM labelled WHERE {FLAGS_TRUE}) m""")
    q["fraud_by_device_accounts"] = _with(["devs"], """
        SELECT total_accounts AS "CountDistinct", total_transactions, total_frauds,
               100 * total_frauds / nullif(total_transactions, 0) AS fraud_rate
        FROM (SELECT d.total_accounts,
                     count(DISTINCT d.transaction_id) AS total_transactions,
                     count(DISTINCT d.transaction_id) FILTER (WHERE f.transaction_id IS NOT NULL) AS total_frauds
              FROM devs d
              LEFT JOIN transactions_fraud_feedback f ON f.transaction_id = d.transaction_id
              GROUP BY d.total_accounts) m""")

    q |= {name: _metric(name) for name in METRICS}
    near = f"distance_to_frequent_location < {P.distance_plot_cut}"
    q["masked_distances"] = _with(["clean"], "SELECT " + ", ".join(
        f"CASE WHEN {near} THEN {c} END AS {c}" for c in enc_cols)
        + f" FROM ({_zscore('clean', 'distance_to_frequent_location')})")
    q["flow_report"] = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS metric, measure, value FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in out)}"
        f" FROM ({_rounded(name, _metric(name))}) AS m) UNPIVOT INCLUDE NULLS (value FOR measure IN ({', '.join(out)}))"
        for name, (_, _, _, out) in METRICS.items())
    tables = [("distance_ladder", "bin_rank", "distance_break", "total_frauds", "fraud_rate"),
              ("value_ladder", "bin_rank", "value_break", "total_frauds", "fraud_rate"),
              ("age_ladder", "bin_rank", "age_break", "total_frauds", "fraud_rate"),
              ("fraud_by_device_age", "device_age_days", "CAST(NULL AS VARCHAR)", "total_is_fraud", "fraud_rating"),
              ("fraud_by_hour", "ts_hour", "CAST(NULL AS VARCHAR)", "CAST(round(fraud_rate * total_transactions) AS BIGINT)", "fraud_rate")]
    q["evidence_report"] = "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS evidence, {key} AS key, {label} AS label, total_transactions, {frauds} AS total_frauds,
        {rate} AS fraud_rate FROM ({q[name]}) AS e""" for name, key, label, frauds, rate in tables)
    return q


def _rounded(name: str, sql: str) -> str:
    """The query with its inexact columns rounded as the engine's are."""
    from .catalog import DECIMALS

    places = DECIMALS.get(name) or {}
    if not places:
        return sql
    repl = ", ".join(
        f"CASE WHEN abs({c}) < 1e6 THEN round({c}, {d}) WHEN abs({c}) < 1e8 THEN round({c}, 2) ELSE round({c}) END"
        f" + 0.0 AS {c}" for c, d in places.items())
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS _q"


def oracle_sql() -> dict[str, str]:
    return {name: _rounded(name, sql) for name, sql in _queries().items()}
