import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="riskbands-test-")
    s = (SparkSession.builder.master("local[*]").appName("riskbands-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


COLS = ["transaction_id", "transaction_timestamp", "account_id", "device_id",
        "distance_to_frequent_location", "device_age_days", "is_emulator", "has_fake_location",
        "has_root_permissions", "app_is_tampered", "transaction_value", "client_decision"]


def tx_row(tid, ts=0, account="a1", device="d1", distance=10.0, age=5, flags=(False,) * 4,
           value=50.0, decision="approved"):
    return (tid, ts, account, device, distance, age, *flags, value, decision)


@pytest.fixture(scope="session")
def make_tx(spark):
    from riskbands.sources.schema import FEEDBACK, TRANSACTIONS

    def _make(rows, feedback=()):
        tx = spark.createDataFrame(rows, TRANSACTIONS)
        fb = spark.createDataFrame([(f,) for f in feedback], FEEDBACK)
        return tx, fb
    return _make
