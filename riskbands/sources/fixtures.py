"""Derive the two input tables (transactions, fraud feedback) from the driver's ``events`` table.

The derivation uses integer arithmetic only, so Spark and DuckDB produce the same rows.
The same template renders the Spark SQL select list and the DuckDB one (used by the oracle).
It deliberately creates null keys, shared devices, hour-level timestamp ties, duplicate-free
ids and feedback ids that match no transaction.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path
from .schema import FEEDBACK, TRANSACTIONS

# epoch milliseconds of the hour the event happened in (UTC wall clock of the NTZ value)
_MS = {
    "spark": ("(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
              " - pmod(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts), 3600000))"),
    "duckdb": "epoch_ms(date_trunc('hour', ts))",
}
_STR = {"spark": "string", "duckdb": "varchar"}

_TRANSACTION_ITEMS = [
    "cast(event_id as {STR}) as transaction_id",
    "{MS} as transaction_timestamp",
    "case when event_id % 389 = 7 then null else concat('a', cast(user_id as {STR})) end as account_id",
    "case when event_id % 97 = 5 then null"
    " when event_id % 10 = 0 then concat('s', cast((event_id - event_id % 80) as {STR}))"
    " else concat('u', cast((user_id - user_id % 2) as {STR})) end as device_id",
    "case when event_id % 11 = 3 then null"
    " else cast(((event_id*7919)%100)*((event_id*7919)%100)*((event_id*7919)%100) as double) * 1.25e0"
    " end as distance_to_frequent_location",
    "cast(case when event_id % 53 = 5 then null when event_id % 9 = 0 then 0"
    " else (event_id*104729)%640 - 2 end as int) as device_age_days",
    "case when event_id % 41 = 1 then null else event_id % 67 = 2 end as is_emulator",
    "case when event_id % 43 = 1 then null else event_id % 71 = 2 end as has_fake_location",
    "case when event_id % 47 = 1 then null else event_id % 73 = 2 end as has_root_permissions",
    "case when event_id % 59 = 1 then null else event_id % 79 = 2 end as app_is_tampered",
    "case when event_id % 499 = 11 then null"
    " when event_id % 211 = 7 then value * 100e0 else value * 4e0 end as transaction_value",
    "case when event_type = 'error' then 'denied'"
    " when event_type = 'signup' and event_id % 17 = 0 then 'review'"
    " else 'approved' end as client_decision",
]

_FEEDBACK_MATCHED = ("event_id % 23 = 4 or (event_type = 'error' and event_id % 5 = 1)"
                     " or event_id % 80 = 70")
_FEEDBACK_MISSING = "event_id % 1000 = 1"


def transactions_sql(dialect: str, source: str = "events") -> str:
    return f"select {', '.join(_items(dialect))} from {source}"


def feedback_sql(dialect: str, source: str = "events") -> str:
    s = _STR[dialect]
    return (f"select cast(event_id as {s}) as transaction_id from {source} where {_FEEDBACK_MATCHED}"
            f" union all select concat('missing-', cast(event_id as {s})) as transaction_id"
            f" from {source} where {_FEEDBACK_MISSING}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    df = events.selectExpr(*_items("spark"))
    # pin the declared schema (nullability included) so every consumer sees TRANSACTIONS
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in TRANSACTIONS.fields])


def feedback_from_events(events: DataFrame) -> DataFrame:
    matched = events.where(_FEEDBACK_MATCHED).selectExpr("cast(event_id as string) as transaction_id")
    missing = events.where(_FEEDBACK_MISSING).selectExpr(
        "concat('missing-', cast(event_id as string)) as transaction_id")
    return matched.unionAll(missing)


def load_tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(transactions, transactions_fraud_feedback) derived from ``events``.

    With ``materialize`` (the default) the two tables are written once per session and data
    version as Parquet under the shared checkpoint folder -- the ingest step of the analysis,
    which saves both tables before anything reads them -- and every caller scans those files:
    real Parquet pushdown and pruning, lineage cut at a written table, and no re-derivation per
    query.  ``materialize=False`` returns the lazy derivation.
    """
    if not materialize:
        ev = _events(spark, sf_dir)
        return transactions_from_events(ev), feedback_from_events(ev)
    key = version_key(spark, sf_dir)
    with _LOCK:
        frames = _MATERIALIZED.get(key)
        if frames is None:
            tpath, fpath = _materialize(spark, sf_dir)
            # DataFrames are immutable: one reader per table serves every caller (no re-listing)
            frames = (spark.read.schema(TRANSACTIONS).parquet(tpath),
                      spark.read.schema(FEEDBACK).parquet(fpath))
            _MATERIALIZED[key] = frames
    return frames


_LOCK = threading.Lock()
_MATERIALIZED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def version_key(spark: SparkSession, sf_dir: str) -> tuple:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    try:
        st = os.stat(path)
        stamp: tuple = (os.path.realpath(path), st.st_size, st.st_mtime_ns)
    except OSError:  # not a local path: the files' own sizes and times
        files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size",
                                                "_metadata.file_modification_time").distinct()
        row = files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time")).first()
        stamp = (path, *row)
    return (spark.sparkContext.applicationId, checkpoint_root(spark), *stamp)


def _materialize(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    ev = _events(spark, sf_dir)
    tx, fb = transactions_from_events(ev), feedback_from_events(ev)
    tpath = scratch_path(spark, "transactions")
    fpath = scratch_path(spark, "transactions_fraud_feedback")
    tx.write.mode("errorifexists").parquet(tpath)
    fb.write.mode("errorifexists").parquet(fpath)
    return tpath, fpath


def _items(dialect: str) -> list[str]:
    return [i.format(STR=_STR[dialect], MS=_MS[dialect]) for i in _TRANSACTION_ITEMS]
