"""Sources and sinks."""

import os

import pytest
from pyspark.errors import AnalysisException

from riskbands.session import scratch_path
from riskbands.sources import io as IO
from riskbands.sources.schema import TRANSACTIONS

HEADER = ",".join(f.name for f in TRANSACTIONS.fields)


def write_text(path, text):
    """Write a small local file (the test session's checkpoint dir is on the local disk)."""
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(local, "w") as fh:
        fh.write(text)
    return path


def test_bad_cells_become_null_and_row_is_kept(spark):
    base = scratch_path(spark, "bad-csv")
    p = write_text(base + "/t.csv", HEADER + "\n"
                   "t1,abc,a1,d1,1.5,3.5,true,false,,false,10.0,approved\n"
                   "t2,1000,a2,d2,,7,false,false,false,true,,denied\n")
    rows = {r.transaction_id: r for r in IO.read_csv_schema(spark, p).collect()}
    assert len(rows) == 2
    assert rows["t1"].transaction_timestamp is None and rows["t1"].device_age_days is None
    assert rows["t1"].distance_to_frequent_location == 1.5 and rows["t1"].has_root_permissions is None
    assert rows["t2"].transaction_timestamp == 1000 and rows["t2"].transaction_value is None


def test_inferred_schema(spark):
    p = write_text(scratch_path(spark, "fb-csv") + "/f.csv", "transaction_id,amount\n1,2.5\n2,3\n")
    df = IO.read_csv_inferred(spark, p)
    assert dict(df.dtypes) == {"transaction_id": "int", "amount": "double"}


def test_save_overwrite_and_read_table(spark):
    df = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    name = IO.save_table(spark, df, IO.unique_table_name("t"))
    assert sorted(r[0] for r in IO.read_table(spark, name).collect()) == ["a", "b"]
    with pytest.raises(AnalysisException):
        IO.save_table(spark, df, name)
    IO.overwrite_table(spark, df.where("transaction_id = 'b'").selectExpr("transaction_id", "1 as x"), name)
    assert [tuple(r) for r in IO.read_table(spark, name).collect()] == [("b", 1)]


def test_overwrite_leaves_one_location_and_drop_none(spark):
    import glob
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/riskbands"
    df = spark.createDataFrame([("a",)], "transaction_id string")
    name = IO.save_table(spark, df, IO.unique_table_name("leak"))
    for k in range(3):
        IO.overwrite_table(spark, df.selectExpr("transaction_id", f"{k} as x"), name)
    assert len(glob.glob(f"{root}/table-{name}-*")) == 1
    assert [tuple(r) for r in IO.read_table(spark, name).collect()] == [("a", 2)]
    IO.drop_table(spark, name)
    assert not glob.glob(f"{root}/table-{name}-*") and not spark.catalog.tableExists(name)


def test_parquet_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0)], "transaction_id string, v double")
    p = IO.write_parquet(df, scratch_path(spark, "pq"))
    assert [tuple(r) for r in IO.scan_parquet(spark, p).collect()] == [("a", 1.0)]


def test_scratch_paths_are_under_checkpoint_dir(spark):
    root = spark.sparkContext.getCheckpointDir()
    assert root and scratch_path(spark, "x").startswith(root.rstrip("/"))
