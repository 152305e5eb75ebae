"""The runtime filter of shared devices: exact results, few foreign rows in the join's exchange."""

import re

import pytest
from pyspark.sql import functions as F

from riskbands.functions import bloom
from riskbands.operators.device_history import accounts_per_device_history, kth_first_seen, on_devices, shared_device_tx
from riskbands.policy import Policy

from .conftest import tx_row


@pytest.mark.parametrize("log2_words", [1, 6, 17])
def test_no_key_is_lost(spark, log2_words):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("device_id"))
    keys = keys.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS device_id"))
    words = bloom.bloom_filter(keys, "device_id", log2_words)
    hit = keys.select("device_id", bloom.might_contain(words, F.col("device_id"), log2_words).alias("hit"))
    assert hit.where("device_id IS NOT NULL AND NOT hit").count() == 0
    other = spark.range(3000).select(F.concat(F.lit("other"), F.col("id")).alias("device_id"))
    passed = other.where(bloom.might_contain(words, F.col("device_id"), log2_words)).count()
    assert passed <= 20 or log2_words < 17


def test_no_keys_let_nothing_pass(spark):
    words = bloom.bloom_filter(spark.sql("SELECT '' AS device_id LIMIT 0"), "device_id")
    assert spark.range(50).where(bloom.might_contain(words, F.col("id").cast("string"))).count() == 0


def test_size_is_bounded(spark):
    with pytest.raises(ValueError):
        bloom.bloom_filter(spark.range(1).select(F.lit("a").alias("device_id")), "device_id", 40)


@pytest.fixture(scope="module")
def few_shared(spark, make_tx, tmp_path_factory):
    """20,000 rows on 2,000 devices, of which every hundredth has 5 accounts and the others one."""
    _, fb = make_tx([])
    tx = make_tx([tx_row("t")])[0]
    n = F.col("id")
    device = n % 2000
    rows = spark.range(20_000).select(
        F.concat(F.lit("t"), n).alias("transaction_id"), (n * 1000).alias("transaction_timestamp"),
        F.when(device % 100 == 0, F.concat(F.lit("a"), F.floor(n / 2000) % 5)).otherwise(F.lit("one")).alias("account_id"),
        F.concat(F.lit("d"), device).alias("device_id"))
    for f in tx.schema.fields[4:]:
        rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    path = str(tmp_path_factory.mktemp("few") / "tx")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_rows_before_the_exchange_fall_to_the_qualifying_share(few_shared):
    kth = kth_first_seen(few_shared, 4)
    assert kth.count() == 20
    left = on_devices(few_shared, kth, Policy().device_filter_log2_words)
    assert 200 <= left.count() <= 200 * 1.1  # 1 % of the rows, and the filter's error
    tight = on_devices(few_shared, kth, 1)
    assert 200 <= tight.count() <= 20_000


def test_filter_stands_below_the_exchange(few_shared):
    plan = shared_device_tx(few_shared)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [k for k, x in enumerate(lines) if re.search(r"Filter .*xxhash64\(device_id", x)]
    assert at, plan
    above = "\n".join(lines[:at[0]])
    assert "Exchange hashpartitioning" in above and "FileScan" not in above


@pytest.mark.parametrize("log2_words", [1, 17])
def test_results_stay_exact(few_shared, log2_words):
    want = accounts_per_device_history(few_shared).where("total_accounts >= 4").select("transaction_id")
    got = shared_device_tx(few_shared, Policy(device_filter_log2_words=log2_words))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
