"""Profiles of the raw transactions: counts per attribute, flag and sharing profiles,
null counts and the numeric encoding used by the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ident, sql_str, utc_hour
from ..sources.schema import FLAG_COLUMNS
from .bands import ID, label_fraud

# numeric view of the labelled transactions, in this order (fixed values)
NUMERIC_COLUMNS = ["transaction_timestamp", "distance_to_frequent_location", "device_age_days",
                   "is_emulator", "has_fake_location", "has_root_permissions", "app_is_tampered",
                   "transaction_value", "client_decision", "is_fraud"]
CLEAN_COLUMNS = ["distance_to_frequent_location", "device_age_days", "transaction_value"]


def tx_by_device_age(tx: DataFrame) -> DataFrame:
    """(device_age_days, total_transactions) with distinct ids; null age is its own group."""
    return (tx.groupBy("device_age_days").agg(F.count_distinct(ID).alias("total_transactions"))
            .orderBy("device_age_days"))


def tx_by_hour(tx: DataFrame) -> DataFrame:
    """(ts_hour, total_transactions): transactions per UTC hour of day."""
    return (tx.select(utc_hour(F.col("transaction_timestamp")).alias("ts_hour"), ID)
            .groupBy("ts_hour").agg(F.count(ID).alias("total_transactions"))
            .orderBy(F.desc("total_transactions"), "ts_hour"))


def tx_by_decision(tx: DataFrame) -> DataFrame:
    return tx.groupBy("client_decision").agg(F.count(ID).alias("total_transactions"))


def flag_profile(tx: DataFrame) -> DataFrame:
    """(column_name, total_true, total_nulls) per device flag, from one scan.

    A flag that is never true and never null has no row (the per-flag filter is empty).
    """
    aggs = []
    for f in FLAG_COLUMNS:
        c = F.col(f)
        aggs += [F.count(F.when(c == F.lit(True), F.col(ID))).alias(f"{f}__true"),
                 F.count(F.when(c.isNull(), F.col(ID))).alias(f"{f}__nulls"),
                 F.count(F.when((c == F.lit(True)) | c.isNull(), F.lit(1))).alias(f"{f}__rows")]
    one = tx.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("column_name"), F.col(f"{f}__true").alias("total_true"),
                              F.col(f"{f}__nulls").alias("total_nulls"), F.col(f"{f}__rows").alias("rows"))
                     for f in FLAG_COLUMNS])
    return (one.select(F.inline(rows)).where(F.col("rows") > 0)
            .select("column_name", "total_true", "total_nulls"))


def devices_per_account(tx: DataFrame) -> DataFrame:
    return (tx.groupBy("account_id").agg(F.count_distinct("device_id").alias("total_devices"))
            .orderBy(F.desc("total_devices"), "account_id"))


def accounts_per_device(tx: DataFrame) -> DataFrame:
    return (tx.groupBy("device_id").agg(F.count_distinct("account_id").alias("total_accounts"))
            .orderBy(F.desc("total_accounts"), "device_id"))


def encode_features(tx: DataFrame, feedback: DataFrame) -> DataFrame:
    """Labelled transactions in numeric form: flags as 0/1 (null kept), decision
    approved->1 / denied->0 / other->null, is_fraud 0/1, plus ``transaction_ts`` (UTC, no zone)."""
    lf = label_fraud(tx, feedback)
    out = []
    for c in lf.columns:
        if c in FLAG_COLUMNS:
            out.append(F.col(c).cast("int").alias(c))
        elif c == "client_decision":
            out.append(F.when(F.col(c) == "approved", 1).when(F.col(c) == "denied", 0).alias(c))
        else:
            out.append(F.col(c))
    out.append(F.expr("timestampadd(MILLISECOND, transaction_timestamp, "
                      "TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("transaction_ts"))
    return lf.select(*out)


def null_counts(frame: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column, from one scan."""
    one = frame.agg(*[F.expr(f"count(*) - count({ident(c)})").alias(c) for c in frame.columns])
    rows = ", ".join(f"named_struct('column_name', {sql_str(c)}, 'nulls', CAST({ident(c)} AS BIGINT))"
                     for c in frame.columns)
    return one.selectExpr(f"inline(array({rows}))")
