"""Tables whose replacement readers never see half done: an append-only list of versions beside the data.

A table is a folder. Every version of its rows is a folder of its own below it (``data-<id>``, written by Spark's
committer); the file ``_versions/<number>`` holds the name of version <number>. A writer finishes the data first and
then creates the next number's file: under another name, and renamed, which a file system does at once and refuses if
the name is taken (another writer was faster: it takes the next number). A reader takes the greatest number there is.
So it finds the old rows or the new ones at any time, and a writer that dies between the two steps leaves the table as
it was, with some files that nobody reads.

``vacuum`` removes what no reader needs any more: versions that were replaced longer ago than the grace period, and data
without a number as old as that. Every version keeps its own schema, so a replacement may change it.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

GRACE_SECONDS = 24 * 3600
_MARKS = "_versions"


class Version(NamedTuple):
    number: int
    path: str
    since_ms: int  # when it became the newest one


class _Folder:
    """The few file-system calls needed, on whatever file system the path lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def children(self, name: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of what lies in a folder below the table, nothing if it is not there."""
        there = self.path(f"{self.root}/{name}".rstrip("/"))
        if not self.fs.exists(there):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(there)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Make a file with this text appear at once; False if the name is taken."""
        target, draft = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/{_MARKS}/.draft-{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # a local file system's rename replaces its target, so that is looked up as well
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All versions of the table, oldest first."""
    folder = _Folder(spark, root)
    marks = sorted((int(name), since) for name, since in folder.children(_MARKS) if name.isdigit())
    return [Version(n, f"{folder.root}/{folder.read(f'{_MARKS}/{n}')}", since) for n, since in marks]


def newest(spark: SparkSession, root: str) -> Version | None:
    folder = _Folder(spark, root)
    numbers = [int(name) for name, _ in folder.children(_MARKS) if name.isdigit()]
    if not numbers:
        return None
    n = max(numbers)
    since = dict(folder.children(_MARKS))[str(n)]
    return Version(n, f"{folder.root}/{folder.read(f'{_MARKS}/{n}')}", since)


def publish(spark: SparkSession, df: DataFrame, root: str) -> Version:
    """Make the rows of ``df`` (which may read the table itself) the table's newest version."""
    folder, name = _Folder(spark, root), f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{folder.root}/{name}")
    while True:
        now = newest(spark, root)
        n = now.number + 1 if now else 1
        if folder.create_once(f"{_MARKS}/{n}", name):
            return newest(spark, root)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of one of the older ones that are still there."""
    if number is None:
        found = newest(spark, root)
    else:
        found = next((v for v in versions(spark, root) if v.number == number), None)
    if found is None:
        raise FileNotFoundError(f"no {'version' if number is None else f'version {number}'} of a table in {root}")
    return spark.read.parquet(found.path)


def vacuum(spark: SparkSession, root: str, grace_seconds: float = GRACE_SECONDS) -> int:
    """Remove versions replaced longer ago than the grace period, and data that never became one; how many folders went.

    The newest version always stays.
    """
    folder, kept = _Folder(spark, root), versions(spark, root)
    before = time.time() * 1000 - grace_seconds * 1000
    gone = 0
    for v, successor in zip(kept, kept[1:], strict=False):
        if successor.since_ms <= before:
            folder.delete(v.path.rsplit("/", 1)[1])
            folder.delete(f"{_MARKS}/{v.number}")  # the number after the data: a failed vacuum is taken up again
            gone += 1
    named = {v.path.rsplit("/", 1)[1] for v in kept}
    for name, since in folder.children(""):
        if name.startswith("data-") and name not in named and since <= before:
            folder.delete(name)
            gone += 1
    return gone
