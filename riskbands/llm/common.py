"""What several operators share: table reading, written intermediates, distributed row order."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbands.session import scratch_path

#: Words as most operators take them: runs of anything but ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


@lru_cache(4)
def _shipped(application: str) -> None:
    """Send the package to the Python workers, unless they find it as the driver does."""
    package = Path(__file__).resolve().parents[1]
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package.parent in [*found, Path.cwd().resolve()]:
        return
    archive = Path(tempfile.mkdtemp(prefix="riskbands-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _shipped(spark.sparkContext.applicationId)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LEFT: dict[tuple[str, int], list[str]] = {}


def left(spark: SparkSession) -> list[str]:
    """The folders that ``written`` has made in this application and thread and that are still there."""
    return _LEFT.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    This cuts lineage (a lost executor costs at most the tasks it held) and gives the optimizer the
    measured size of the result, so that it can pick a broadcast or a sort-merge join by size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    left(spark).append(path)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(*frames: DataFrame) -> set[str]:
    """The folders and files that the frames' plans read, as they were named to the reader."""
    found = set()
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            if leaves.apply(k).nodeName().startswith("LogicalRelation"):
                roots = leaves.apply(k).relation().location().rootPaths()
                found |= {roots.apply(j).toUri().getPath() for j in range(roots.size())}
    return found


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``written`` has made."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        left(spark).remove(p)


def left_by(spark: SparkSession, *frames: DataFrame) -> list[str]:
    """Those of :func:`left` that the frames read."""
    read, path = folders(*frames), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in left(spark) if path(p).toUri().getPath() in read]


def discard(*frames: DataFrame) -> None:
    """Delete the folders that ``written`` made for these frames. Whoever discards a frame has no plan left that reads it."""
    if frames:
        delete(frames[0].sparkSession, left_by(frames[0].sparkSession, *frames))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what ``written`` made inside the block when it ends or fails, but for what the frames in the list read."""
    before = set(left(spark))
    kept: list[DataFrame] = []
    try:
        yield kept
    except BaseException:
        kept = []
        raise
    finally:
        needed = {*before, *left_by(spark, *kept)}
        delete(spark, [p for p in left(spark) if p not in needed])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of each action that ends inside the block.

    Used around a write whose result is reread from files, so its shuffle files are never needed again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def merge_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by sort and merge whatever their estimated sizes.

    Spark takes a side's size from its files, times the share of the columns that it reads by their types alone. Rows
    that compress well or are cut to a narrow column then pass for many times smaller than they are, and such a side
    would be broadcast through the driver's memory; the plan isn't changed back when the size is known.
    """
    return left.join(right.hint("merge"), on, how)


def words(text: Column) -> Column:
    """Words of a text as an array: runs of anything but space and \\t..\\r; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def adjacent(first: str, second: str, step: int, out: str) -> str:
    """SQL for ``out`` over (first[i], second[i + step]) for every i that has both; a, b name the two."""
    n = f"greatest(size({second}) - {step}, 0)"
    return f"zip_with(slice({first}, 1, {n}), slice({second}, {step + 1}, {n}), (a, b) -> {out})"
