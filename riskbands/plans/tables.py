"""The derived tables of the analysis, computed once and saved, for running many reports.

``build_tables`` saves the input and everything derived from it as Parquet catalog tables under the shared
checkpoint folder (each write cuts the lineage). Tables with transaction ids are bucketed and sorted by the id,
equally many buckets each: the label join, the anti join, the band join and every reduction to one row per id
read them without a shuffle. Rows without an id match no join and need no reduction; they are kept in plain tables
beside (``Halves``), so that they don't all land in one bucket.

``by_distance`` holds the transactions clustered by distance, so that a rule on it reads only the files that can have
hits; its ids have Parquet Bloom filters.

The metric operators take ``banded``, the evidence operators ``base``; both stand for the saved tables. An id that
many rows repeat lies in one bucket with all of them (ids are meant to be unique).
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators.bands import Halves
from ..operators.device_history import shared_device_tx
from ..operators.profile import encode_features
from ..policy import DEFAULT, Policy
from ..sources import io as IO
from ..sources.fixtures import load_tables, version_key


@dataclass(frozen=True)
class DerivedTables:
    transactions: Halves
    by_distance: DataFrame
    feedback: DataFrame
    high_risk_band: DataFrame
    banded: Halves
    base: Halves

    @property
    def transactions_with_bands(self) -> DataFrame:
        return self.banded.whole()

    @property
    def transactions_without_high_risk(self) -> DataFrame:
        return self.base.whole()


def build_tables(spark: SparkSession, tx: DataFrame, feedback: DataFrame, policy: Policy = DEFAULT,
                 prefix: str = "", buckets: int | None = None) -> DerivedTables:
    """Save the tables; ``buckets`` defaults to the session's number of shuffle partitions."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(df: DataFrame, name: str) -> DataFrame:
        return IO.read_table(spark, IO.save_table(spark, df, IO.unique_table_name(prefix + name)))

    def by_id(df: DataFrame, name: str) -> DataFrame:
        return IO.read_table(spark, IO.save_bucketed(spark, df, IO.unique_table_name(prefix + name), B.ID, buckets))

    def halves(h: Halves, name: str) -> Halves:
        return Halves(by_id(h.known, name), save(h.unknown, f"{name}_without_id"))

    stored = halves(Halves.of(tx), "transactions")
    labels = by_id(feedback.where(F.col(B.ID).isNotNull()), "transactions_fraud_feedback")
    rows = stored.whole()
    shared = save(shared_device_tx(rows, policy, distinct_groups=False), "shared_device_tx")
    high = by_id(ids_once(B.high_risk_rows(rows, policy, shared), buckets), "high_risk_band")
    # a broadcast of a small side would read the wide side unbucketed, and its result would be dealt out again
    banded = halves(B.risk_band_halves(stored, labels.hint("merge"), policy, high.hint("merge")),
                    "transactions_with_bands")
    off = ids_once(B.off_base(rows, policy, shared), buckets)
    base = halves(B.label_halves(stored, labels.hint("merge"), off.hint("merge")), "transactions_without_high_risk")
    far = IO.read_table(spark, IO.save_clustered(spark, rows, IO.unique_table_name(prefix + "transactions_by_distance"),
                                                 "distance_to_frequent_location", B.ID, buckets))
    return DerivedTables(stored, far, labels, high, banded, base)


def ids_once(ids: DataFrame, buckets: int) -> DataFrame:
    """Distinct ids but null, dealt out as the buckets are: one shuffle of ids for both."""
    return ids.where(F.col(B.ID).isNotNull()).repartition(buckets, B.ID).distinct()


_LOCK = threading.RLock()
_STORED: dict[tuple, DerivedTables] = {}
_FEATURES: dict[tuple, DataFrame] = {}


def stored_tables(spark: SparkSession, sf_dir: str) -> DerivedTables:
    """The derived tables of ``load_tables``, built once per session and data version."""
    key = version_key(spark, sf_dir)
    tx, feedback = load_tables(spark, sf_dir)
    with _LOCK:
        if key not in _STORED:
            _STORED[key] = build_tables(spark, tx, feedback)
    return _STORED[key]


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rows of ``load_tables``, saved once per session and data version."""
    key = version_key(spark, sf_dir)
    with _LOCK:
        if key not in _FEATURES:
            rows = encode_features(*load_tables(spark, sf_dir))
            name = IO.save_table(spark, rows, IO.unique_table_name("transactions_encoded"))
            _FEATURES[key] = IO.read_table(spark, name)
    return _FEATURES[key]
