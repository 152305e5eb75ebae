"""Sources and sinks: CSV (inferred or explicit schema), Parquet tables and paths.

Writes go below the session's shared checkpoint folder (``spark.checkpoint.dir``), never to a
machine-local default, and every write uses a fresh path / table name.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import checkpoint_root, scratch_path
from .schema import FEEDBACK, TRANSACTIONS


def read_csv_inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header row and an inferred schema (one extra pass over the file)."""
    return (spark.read.format("csv").option("inferSchema", "true").option("header", "true")
            .option("sep", sep).load(path))


def read_csv_schema(spark: SparkSession, path: str, schema: StructType = TRANSACTIONS,
                    sep: str = ",") -> DataFrame:
    """CSV with a header row and a fixed schema.  PERMISSIVE: a bad cell becomes null and
    the row is kept."""
    return (spark.read.format("csv").option("header", "true").option("sep", sep)
            .option("mode", "PERMISSIVE").schema(schema).load(path))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("errorifexists").option("header", "true").option("sep", sep).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unique_table_name(prefix: str) -> str:
    return f"{re.sub(r'[^a-z0-9_]', '_', prefix.lower())}_{uuid.uuid4().hex[:12]}"


def save_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "errorifexists",
               location: str | None = None) -> str:
    """Save as a Parquet catalog table stored under the shared scratch folder.

    Default mode fails if the table exists; ``mode="overwrite"`` replaces it (the
    CREATE OR REPLACE TABLE ... AS SELECT of the analysis).
    """
    location = location or scratch_path(spark, f"table-{name}")
    (df.write.format("parquet").mode(mode).option("path", location).saveAsTable(name))
    return name


def save_bucketed(spark: SparkSession, df: DataFrame, name: str, column: str, buckets: int) -> str:
    """Save as a Parquet catalog table bucketed and sorted by ``column``: one file a bucket.

    Joins and reductions by ``column`` read such tables without a shuffle when both sides have equally many
    buckets. Rows that are dealt out by ``column`` already (a join of two bucketed tables) are written as they lie.
    """
    if _buckets_of(df, column) != buckets:
        df = df.repartition(buckets, column)
    location = scratch_path(spark, f"table-{name}")
    (df.write.format("parquet").bucketBy(buckets, column).sortBy(column)
     .mode("errorifexists").option("path", location).saveAsTable(name))
    return name


def save_clustered(spark: SparkSession, df: DataFrame, name: str, column: str, tie: str, files: int) -> str:
    """Save as a Parquet catalog table clustered by ``column``: each file holds one range of it, in order.

    A filter on ``column`` then skips the files and row groups of other ranges by their statistics. Rows of equal
    value (null included) are spread over as many ranges as they fill, by ``tie``, which gets Parquet Bloom filters:
    a look-up by it skips the row groups that don't hold it.
    """
    location = scratch_path(spark, f"table-{name}")
    (df.repartitionByRange(files, column, tie).sortWithinPartitions(column, tie)
     .write.format("parquet").mode("errorifexists").option("path", location)
     .option(f"parquet.bloom.filter.enabled#{tie}", "true").saveAsTable(name))
    return name


def _buckets_of(df: DataFrame, column: str) -> int | None:
    """Number of partitions if the plan of ``df`` deals its rows out by the hash of ``column`` alone."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = re.fullmatch(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan.outputPartitioning().toString().lower())
    return int(found[2]) if found and found[1] == column.lower() else None


def _location(spark: SparkSession, name: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return row.data_type if row else None


def _remove(spark: SparkSession, location: str | None) -> None:
    """Delete a folder that this library wrote; anything outside the shared scratch folder stays."""
    jvm = spark.sparkContext._jvm
    path, root = (jvm.org.apache.hadoop.fs.Path(p) for p in (location or "/", checkpoint_root(spark)))
    if path.toUri().getPath().startswith(root.toUri().getPath().rstrip("/") + "/"):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def overwrite_table(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Replace the table's contents and schema with ``df``.

    The new version is written to a fresh location, so ``df`` may read the table itself; once the
    catalog points there, the superseded location is removed.
    """
    old = _location(spark, name)
    save_table(spark, df, name, mode="overwrite")
    if old and old != _location(spark, name):
        _remove(spark, old)
    return name


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table that :func:`save_table` made, with its files."""
    old = _location(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _remove(spark, old)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


__all__ = ["read_csv_inferred", "read_csv_schema", "write_csv", "write_parquet", "scan_parquet",
           "save_table", "save_bucketed", "save_clustered", "overwrite_table", "drop_table", "read_table", "unique_table_name", "TRANSACTIONS", "FEEDBACK"]
