"""Evidence tables: fraud rate per bin / group over the non-high-risk base (or all rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_flag_true, safe_div, utc_hour
from ..functions.ladders import AGE_LADDER, DISTANCE_LADDER, VALUE_LADDER, BinSpec
from ..policy import DEFAULT, Policy
from .bands import ID, Halves, fraud_ids, label_fraud
from .device_history import accounts_per_device_history


def ladder(base: DataFrame, spec: BinSpec) -> DataFrame:
    """(label, bin_rank, total_transactions, total_frauds, fraud_rate %) per bin.

    Aggregates on the integer rank; the label is attached to the (at most n+2) result rows.
    """
    agg = (base.select(spec.rank().alias("bin_rank"), ID, "is_fraud")
           .groupBy("bin_rank")
           .agg(F.count_distinct(ID).alias("total_transactions"),
                F.sum("is_fraud").alias("total_frauds")))
    return (agg.select(spec.label_of("bin_rank").alias(spec.label_column), "bin_rank",
                       "total_transactions", "total_frauds",
                       safe_div(F.lit(100) * F.col("total_frauds"),
                                F.col("total_transactions")).alias("fraud_rate"))
            .orderBy("bin_rank"))


def distance_ladder(base: DataFrame) -> DataFrame:
    return ladder(base, DISTANCE_LADDER)


def value_ladder(base: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Value ladder over rows with distance < ``value_ladder_max_distance`` (null drops)."""
    near = base.where(F.col("distance_to_frequent_location") < policy.value_ladder_max_distance)
    return ladder(near, VALUE_LADDER)


def age_ladder(base: DataFrame) -> DataFrame:
    return ladder(base, AGE_LADDER)


def fraud_by_device_age(base: DataFrame) -> DataFrame:
    """(device_age_days, total_is_fraud, total_transactions, fraud_rating %)."""
    agg = base.groupBy("device_age_days").agg(F.sum("is_fraud").alias("total_is_fraud"),
                                              F.count_distinct(ID).alias("total_transactions"))
    return agg.select("device_age_days", "total_is_fraud", "total_transactions",
                      safe_div(F.lit(100) * F.col("total_is_fraud"),
                               F.col("total_transactions")).alias("fraud_rating"))


def fraud_by_hour(base: DataFrame) -> DataFrame:
    """(ts_hour, total_transactions, fraud_rate as a fraction) per UTC hour of day."""
    agg = (base.select(utc_hour(F.col("transaction_timestamp")).alias("ts_hour"), ID, "is_fraud")
           .groupBy("ts_hour").agg(F.count(ID).alias("total_transactions"),
                                   F.sum("is_fraud").alias("_frauds")))
    return (agg.select("ts_hour", "total_transactions",
                       safe_div(F.col("_frauds"), F.col("total_transactions")).alias("fraud_rate"))
            .orderBy(F.desc("total_transactions"), "ts_hour"))


def _keys(policy: Policy) -> dict[str, Column]:
    """How each table of :func:`evidence_report` keys a row of the base; a ladder leaves out a row without a key."""
    none = F.lit(None).cast("int")
    near = F.col("distance_to_frequent_location") < policy.value_ladder_max_distance
    return {"distance_ladder": DISTANCE_LADDER.rank(), "value_ladder": F.when(near, VALUE_LADDER.rank()).otherwise(none),
            "age_ladder": AGE_LADDER.rank(), "fraud_by_device_age": F.col("device_age_days"),
            "fraud_by_hour": utc_hour(F.col("transaction_timestamp"))}


def evidence_counts(base: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    """(evidence, key, rows, ids, frauds) of the five tables from one scan of the base.

    Every row is keyed for all tables at once and turned into one row a table. Rows with an id are reduced to one per
    (table, key, id): on a base that is dealt out by id (:mod:`plans.tables`) that needs no shuffle, as the id is
    among the keys. Rows without an id count in no ``ids``. ``rows`` counts rows with an id.
    """
    keys = _keys(policy)
    ladders = [n for n in keys if n.endswith("_ladder")]
    known, unknown = Halves.of(base)

    def keyed(rows: DataFrame) -> DataFrame:
        # a ladder places every row that it looks at; ages and hours keep null as a group of their own
        narrow = rows.select(ID, "is_fraud", *[c.cast("int").alias(n) for n, c in keys.items()])
        tall = ", ".join(f"'{n}', `{n}`" for n in keys)
        tall = narrow.selectExpr(ID, "is_fraud", f"stack({len(keys)}, {tall}) AS (evidence, key)")
        return tall.where(F.col("key").isNotNull() | ~F.col("evidence").isin(ladders))

    per_id = keyed(known).groupBy("evidence", "key", ID).agg(F.sum("is_fraud").alias("f"), F.count(F.lit(1)).alias("n"))
    counts = per_id.groupBy("evidence", "key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"),
                                                   F.sum("f").alias("frauds"))
    zero = F.lit(0).cast("long")
    other = keyed(unknown).groupBy("evidence", "key").agg(F.sum("is_fraud").alias("frauds")).select(
        "evidence", "key", zero.alias("rows"), zero.alias("ids"), F.col("frauds").cast("long").alias("frauds"))
    return counts.unionByName(other).groupBy("evidence", "key").agg(
        *[F.sum(c).alias(c) for c in ("rows", "ids", "frauds")])


def evidence_report(base: DataFrame | Halves, policy: Policy = DEFAULT) -> DataFrame:
    """(evidence, key, label, total_transactions, total_frauds, fraud_rate): the tables Q16 to Q20 as one.

    ``key`` is the bin's rank, the age or the hour; ``label`` the bin's label (null for ages and hours). The hour's
    transactions are rows and its rate a fraction, the others' are distinct ids and percent, as in the single tables.
    """
    hour = F.col("evidence") == "fraud_by_hour"
    n = F.when(hour, F.col("rows")).otherwise(F.col("ids"))
    specs = {"distance_ladder": DISTANCE_LADDER, "value_ladder": VALUE_LADDER, "age_ladder": AGE_LADDER}
    label = F.lit(None).cast("string")
    for name, spec in specs.items():
        label = F.when(F.col("evidence") == name, spec.label_of("key")).otherwise(label)
    return (evidence_counts(base, policy)
            .select("evidence", "key", label.alias("label"), n.alias("total_transactions"), F.col("frauds").alias("total_frauds"),
                    safe_div(F.when(hour, F.lit(1)).otherwise(F.lit(100)) * F.col("frauds"), n).alias("fraud_rate"))
            .orderBy("evidence", "key"))


def flag_fraud_share(tx: DataFrame, feedback: DataFrame) -> DataFrame:
    """Among flagged transactions: share that is fraud (total_frauds) and not (total_no_frauds)."""
    flagged = label_fraud(tx.where(any_flag_true()), feedback)
    n = F.count(ID)
    return flagged.agg(
        safe_div(F.count(F.when(F.col("is_fraud") == 1, F.col(ID))), n).alias("total_frauds"),
        safe_div(F.count(F.when(F.col("is_fraud") == 0, F.col(ID))), n).alias("total_no_frauds"))


def fraud_by_device_accounts(tx: DataFrame, feedback: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(CountDistinct, total_transactions, total_frauds, fraud_rate %) per accounts-so-far value.

    Two distinct counts per group would make Spark Expand every row; instead the rows are
    reduced to one per (count, id) first, then both totals are plain sums.
    """
    # the per-group history (distinct account, id, device, ts with its count), as defined, reduced to
    # distinct (count, id) pairs: at most one null id per count is left, so a plain left join is safe
    pairs = accounts_per_device_history(tx, policy).select("total_accounts", ID).distinct()
    fb = fraud_ids(feedback).distinct()
    per_id = (pairs.join(fb, pairs[ID] == fb["_fb_id"], "left")
              .select("total_accounts", ID, F.col("_fb_id").isNotNull().cast("int").alias("_is_fb")))
    agg = per_id.groupBy(F.col("total_accounts").alias("CountDistinct")).agg(
        F.count(ID).alias("total_transactions"), F.sum("_is_fb").alias("total_frauds"))
    return (agg.select("CountDistinct", "total_transactions", "total_frauds",
                       safe_div(F.lit(100) * F.col("total_frauds"),
                                F.col("total_transactions")).alias("fraud_rate"))
            .orderBy(F.desc("total_transactions"), "CountDistinct"))


__all__ = ["ladder", "distance_ladder", "value_ladder", "age_ladder", "fraud_by_device_age",
           "fraud_by_hour", "flag_fraud_share", "fraud_by_device_accounts",
           "accounts_per_device_history"]
