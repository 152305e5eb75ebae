"""Distinct accounts seen on a device up to (and including) each instant.

The analysis defines it as a self-join ``b.device = a.device and b.ts <= a.ts`` with
``count(distinct b.account)``: quadratic per device.  Spark rejects count(distinct) OVER, and a
plain running window would put a whole device (possibly a third of all rows) in one task.

Plan used here (exact, no pair expansion, bounded partitions):

1. ``first_seen``: min(ts) per (device, account)           -- map-side combined
2. ``points``: one row per distinct (device, ts) with c = #accounts first seen at ts
3. slices: ``bucket = ts div history_bucket_ms``.  Per (device, bucket) the running sum of c
   (rows are distinct millisecond timestamps, so a slice has at most bucket_ms rows);
   per device the sum of c over all *earlier* slices, computed on the small table of
   slice totals.  total_accounts = earlier slices + running sum in the slice.
4. join back to transactions on (device, ts).  Step 2 also counts the transactions of each point, so
   points that very many share (a device that reports one constant time) are known beforehand: their
   transactions are dealt out over several copies of the point (``salted``).

The ``<=`` tie rule holds because all accounts first seen at the same ts land in the same point.

When only the threshold ``count >= k`` is needed (the high band, the evidence base), the
k-th smallest first-seen time per device answers it with fewer shuffles: see
``kth_first_seen`` / ``shared_device_tx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bloom import bloom_filter, might_contain
from ..policy import DEFAULT, Policy

TS = "transaction_timestamp"
MOST_HOT = 10_000


def _base(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("device_id").isNotNull() & F.col(TS).isNotNull())


def _points(tx: DataFrame, keys: DataFrame | None) -> DataFrame:
    """(device_id, ts, c, held): accounts first seen there, and rows of ``keys`` there (combined map-side)."""
    base = _base(tx).select("device_id", "account_id", TS)
    first_seen = (base.where(F.col("account_id").isNotNull())
                  .groupBy("device_id", "account_id").agg(F.min(TS).alias(TS))
                  .select("device_id", TS, F.lit(1).alias("c"), F.lit(0).alias("held")))
    keys = (base if keys is None else keys).select("device_id", TS, F.lit(0).alias("c"), F.lit(1).alias("held"))
    return first_seen.unionByName(keys).groupBy("device_id", TS).agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def device_account_counts(tx: DataFrame, policy: Policy = DEFAULT,
                          keys: DataFrame | None = None) -> DataFrame:
    """(device_id, transaction_timestamp, total_accounts) for every distinct (device, ts).

    ``keys`` may supply the (device_id, ts) rows to answer for (e.g. a projection of a frame
    the caller shuffles anyway, so both uses share that shuffle); by default every
    transaction with a device and a timestamp.
    """
    points = _points(tx, keys).withColumn("bucket", F.floor(F.col(TS) / F.lit(policy.history_bucket_ms)))
    slice_totals = points.groupBy("device_id", "bucket").agg(F.sum("c").alias("n"))
    earlier = Window.partitionBy("device_id").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = slice_totals.select(
        "device_id", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("device_id", "bucket").orderBy(TS).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # every slice has an offset row, so a left join equals the inner one; it also keeps the
    # optimizer from pushing an inferred not-null filter into one copy of ``points``, which
    # would stop the two uses of ``points`` from sharing one shuffle
    return (points.join(offsets, ["device_id", "bucket"], "left")
            .select("device_id", TS, (F.col("before") + F.sum("c").over(inside)).alias("total_accounts")))


def accounts_per_device_history(tx: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row per distinct (account, transaction, device, ts) with the accounts seen so far.

    Rows with a null device or timestamp have no history (they match nothing in the
    self-join definition) and are left out.
    """
    groups = _base(tx).select("account_id", "transaction_id", "device_id", TS).distinct()
    counts = device_account_counts(tx, policy, keys=groups)
    hot = hot_points(_points(tx, groups), policy.hot_point_rows)
    return salted(groups, hot).join(copied(counts, hot), ["device_id", TS, "salt"]).select(
        "account_id", "transaction_id", "device_id", TS, "total_accounts")


def hot_points(points: DataFrame, rows: int) -> DataFrame:
    """(device_id, ts, copies) of the points that more than ``rows`` rows share, at most MOST_HOT of them.

    Every further point holds less than one in MOST_HOT of all rows.
    """
    return (points.where(F.col("held") > rows).orderBy(F.desc("held"), "device_id", TS).limit(MOST_HOT)
            .select(F.col("device_id").alias("_hd"), F.col(TS).alias("_ht"),
                    F.ceil(F.col("held") / F.lit(rows)).cast("int").alias("copies")))


def _beside_hot(frame: DataFrame, hot: DataFrame) -> DataFrame:
    # MOST_HOT bounds the broadcast
    return frame.join(F.broadcast(hot), (F.col("device_id") == F.col("_hd")) & (F.col(TS) == F.col("_ht")), "left")


def salted(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with ``salt``: the copy of their point that they go to, 0 unless the point is hot."""
    salt = F.pmod(F.xxhash64("account_id", "transaction_id"), F.col("copies")).cast("int")
    return _beside_hot(groups, hot).withColumn("salt", F.coalesce(salt, F.lit(0))).drop("_hd", "_ht", "copies")


def copied(points: DataFrame, hot: DataFrame) -> DataFrame:
    """The points with ``salt``, hot ones once for each of their copies."""
    last = F.coalesce(F.col("copies"), F.lit(1)) - 1
    return _beside_hot(points, hot).withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("_hd", "_ht", "copies")


def kth_first_seen(tx: DataFrame, k: int) -> DataFrame:
    """(device_id, kth_ts): the k-th smallest first-seen time over the device's accounts, for
    devices with at least k accounts.  A transaction on the device has >= k accounts seen so
    far exactly when its ts >= kth_ts (ties between accounts included).

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before the shuffle: each
    map task sends at most k rows per device, so even a device with millions of accounts
    reaches its window as a handful of rows.
    """
    first = (_base(tx).where(F.col("account_id").isNotNull())
             .groupBy("device_id", "account_id").agg(F.min(TS).alias("fts")))
    w = Window.partitionBy("device_id").orderBy("fts", "account_id")
    return (first.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .where(F.col("_rn") == k).select("device_id", F.col("fts").alias("kth_ts")))


def on_devices(rows: DataFrame, devices: DataFrame, log2_words: int) -> DataFrame:
    """The rows whose device may be among ``devices``: all that are, and few others (:mod:`functions.bloom`)."""
    return rows.where(might_contain(bloom_filter(devices, "device_id", log2_words), F.col("device_id"), log2_words))


def shared_device_tx(tx: DataFrame, policy: Policy = DEFAULT, distinct_groups: bool = True) -> DataFrame:
    """transaction_id of history rows with >= ``shared_device_accounts`` accounts so far.

    Only the threshold is needed here, so this uses the k-th first-seen time per device (a few
    shuffles) rather than the full count.  A Bloom filter of the devices that reach k accounts drops the
    rows of all others before they are shuffled; the join after it is exact.  It is on device; a hot
    device there is a skewed join key, which AQE's skew-join handling splits.
    With ``distinct_groups`` the result has one row per distinct (account, id, device, ts) group,
    as the history table does; callers that dedup ids anyway pass False to skip that shuffle.
    """
    kth = kth_first_seen(tx, policy.shared_device_accounts)
    rows = on_devices(_base(tx).select("account_id", "transaction_id", "device_id", TS), kth, policy.device_filter_log2_words)
    if distinct_groups:
        rows = rows.distinct()
    return (rows.join(kth, "device_id").where(F.col(TS) >= F.col("kth_ts"))
            .select("transaction_id"))
