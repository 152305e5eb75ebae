"""Risk bands: high-risk rules, the medium/low split and the labelled transaction table.

Every function takes DataFrames (+ Policy) and returns a lazy DataFrame.  Joins are
plain equi-joins on ``transaction_id``; Spark/AQE picks broadcast only when the measured
side is under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merge otherwise.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import any_flag_true, has_null_value, is_low_risk
from ..policy import DEFAULT, Policy
from .device_history import shared_device_tx

ID = "transaction_id"


def rule_any_flag(tx: DataFrame) -> DataFrame:
    """Ids of transactions with any device flag true."""
    return tx.where(any_flag_true()).select(ID)


def rule_far_distance(tx: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Ids of transactions farther than ``far_distance`` from the frequent location."""
    return tx.where(F.col("distance_to_frequent_location") > policy.far_distance).select(ID)


def high_risk_band(tx: DataFrame, policy: Policy = DEFAULT, shared: DataFrame | None = None) -> DataFrame:
    """Distinct ids hit by any high-risk rule (shared device, flags, distance)."""
    return high_risk_rows(tx, policy, shared).distinct()


def high_risk_rows(tx: DataFrame, policy: Policy = DEFAULT, shared: DataFrame | None = None) -> DataFrame:
    """The ids of :func:`high_risk_band`, once for each rule and row that hits."""
    shared = shared_device_tx(tx, policy, distinct_groups=False) if shared is None else shared
    return shared.unionByName(rule_any_flag(tx)).unionByName(rule_far_distance(tx, policy))


def fraud_ids(feedback: DataFrame) -> DataFrame:
    """The feedback's known ids as ``_fb_id``.

    Ids are strings: a number that a reader inferred has lost its leading zeros ("007" became 7), so
    it is refused here instead of matching other transactions or failing in the middle of a job.
    """
    kind = feedback.schema[ID].dataType
    if not isinstance(kind, StringType):
        raise TypeError(f"feedback {ID} must be a string, not {kind.simpleString()}: read it with the FEEDBACK schema")
    return feedback.select(F.col(ID).alias("_fb_id")).where(F.col("_fb_id").isNotNull())


def split_null_ids(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, rows without).  A null id never matches an equi-join, so those rows
    skip the id joins instead of all hashing to one reducer (a hot null key would otherwise
    land a large share of the table in a single task)."""
    return tx.where(F.col(ID).isNotNull()), tx.where(F.col(ID).isNull())


class Halves(NamedTuple):
    """Rows with an id, which the id joins have partitioned by it, and the rows without."""

    known: DataFrame
    unknown: DataFrame

    @staticmethod
    def of(frame: DataFrame | Halves) -> Halves:
        return frame if isinstance(frame, Halves) else Halves(*split_null_ids(frame))

    @property
    def columns(self) -> list[str]:
        return self.known.columns

    def select(self, *columns) -> Halves:
        return Halves(self.known.select(*columns), self.unknown.select(*columns))

    def where(self, condition) -> Halves:
        return Halves(self.known.where(condition), self.unknown.where(condition))

    def whole(self) -> DataFrame:
        return self.known.unionByName(self.unknown)


def _labelled(known: DataFrame, feedback: DataFrame) -> DataFrame:
    fb = fraud_ids(feedback)
    return (known.join(fb, known[ID] == fb["_fb_id"], "left")
            .select(*[known[c] for c in known.columns],
                    F.when(F.col("_fb_id").isNotNull(), 1).otherwise(0).alias("is_fraud")))


def label_halves(tx: DataFrame | Halves, feedback: DataFrame, without: DataFrame | None = None) -> Halves:
    """Labelled rows whose id is not in ``without``; rows without an id join nothing and are no fraud."""
    known, unknown = Halves.of(tx)
    if without is not None:
        known = known.join(without, ID, "left_anti")
    return Halves(_labelled(known, feedback), unknown.withColumn("is_fraud", F.lit(0)))


def label_fraud(tx: DataFrame, feedback: DataFrame) -> DataFrame:
    """Transactions plus ``is_fraud`` (1 when a feedback row matches the id).

    Left-join semantics: a feedback id listed twice yields the transaction twice.
    """
    return label_halves(tx, feedback).whole()


def label_fraud_sql(spark, tx: DataFrame, feedback: DataFrame) -> DataFrame:
    """``label_fraud`` stated as SQL text (``spark.sql`` with DataFrame parameters; no global
    views).  Same rows and plan shape as the DataFrame form, null ids included."""
    return spark.sql(
        """
        SELECT t.*, CASE WHEN f.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS is_fraud
        FROM {tx} t
        LEFT JOIN (SELECT transaction_id FROM {fb} WHERE transaction_id IS NOT NULL) f
          ON t.transaction_id = f.transaction_id
        WHERE t.transaction_id IS NOT NULL
        UNION ALL
        SELECT t.*, 0 AS is_fraud FROM {tx} t WHERE t.transaction_id IS NULL
        """, tx=tx, fb=feedback)


def medium_low_band(tx: DataFrame, feedback: DataFrame, policy: Policy = DEFAULT,
                    high: DataFrame | None = None) -> DataFrame:
    """Transactions not in the high band, with ``is_fraud`` and ``has_null_value``."""
    high = high_risk_band(tx, policy) if high is None else high
    return label_halves(tx, feedback, high).whole().withColumn("has_null_value", has_null_value())


def risk_band_halves(tx: DataFrame | Halves, feedback: DataFrame, policy: Policy = DEFAULT,
                     high: DataFrame | None = None) -> Halves:
    """:func:`risk_bands` as its two halves, for reductions by id that reuse the joins' partitioning."""
    high = high_risk_band(tx, policy) if high is None else high
    hb = high.select(F.col(ID).alias("_hr_id")).where(F.col("_hr_id").isNotNull())

    def banded(rows: DataFrame, is_high) -> DataFrame:
        return rows.withColumn("has_null_value", has_null_value()).select(
            *tx.columns, "is_fraud",
            F.when(is_high, "high").when(is_low_risk(policy), "low").otherwise("mid").alias("risk_band"))

    known, unknown = label_halves(tx, feedback)
    known = known.join(hb, known[ID] == hb["_hr_id"], "left")
    return Halves(banded(known, F.col("_hr_id").isNotNull()), banded(unknown, F.lit(False)))


def risk_bands(tx: DataFrame, feedback: DataFrame, policy: Policy = DEFAULT,
               high: DataFrame | None = None) -> DataFrame:
    """Every transaction with ``is_fraud`` and ``risk_band`` (high / mid / low).

    high: id in the high band.  low: value, distance and device age inside the low-risk
    limits and no null in distance or flags.  mid: everything else (a null makes it mid).
    Each row is classified once (ids are matched by equality, so a null id is never high).
    """
    return risk_band_halves(tx, feedback, policy, high).whole()


def band_counts(bands: DataFrame) -> DataFrame:
    """(risk_band, total_transactions) ordered by count."""
    return (bands.groupBy("risk_band").agg(F.count(ID).alias("total_transactions"))
            .orderBy("total_transactions", "risk_band"))


def non_high_risk_base(tx: DataFrame, feedback: DataFrame, policy: Policy = DEFAULT,
                       shared: DataFrame | None = None) -> DataFrame:
    """Labelled transactions minus flagged and shared-device ids.

    The distance rule is *not* applied here, so the distance ladder can show the far bins.
    ``shared``: the ids of :func:`shared_device_tx`, if they are at hand.
    """
    return label_halves(tx, feedback, off_base(tx, policy, shared).distinct()).whole()


def off_base(tx: DataFrame, policy: Policy = DEFAULT, shared: DataFrame | None = None) -> DataFrame:
    """The ids (repeated) that are not in :func:`non_high_risk_base`: flagged or on a shared device."""
    shared = shared_device_tx(tx, policy, distinct_groups=False) if shared is None else shared
    return rule_any_flag(tx).unionByName(shared).where(F.col(ID).isNotNull())
