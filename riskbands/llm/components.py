"""Connected components of a link table.

Links beyond ONE_TASK are joined to stars in turn (each node to its least larger-side, then smaller-side
neighbour) until nothing moves, on DataFrames and without gathering any node's neighbours. Up to ONE_TASK
links, counted first, fit a single task's memory as a forest of parents and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbands.llm.common import merge_join, written

ONE_TASK = 500_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Move links to each node's least neighbour: of its larger neighbours, or of itself and its smaller ones.

    The least neighbour comes from a pre-aggregated minimum and a join, so a node with very many links is
    never gathered in one group.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = merge_join(both, least, "a")
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.filter("a <> b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (a, b) links of a task, turned to (a, b) with b the least node that a is connected to."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        pairs = [(x, root(x)) for x in list(parent)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([r for _, r in pairs], kind)],
                                         ["a", "b"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links -> (node, root): every linked node with the least node that it is connected to."""
    links = written(links.filter("a <> b").distinct(), "cc")
    if links.count() <= one_task:
        links = written(links.coalesce(1).mapInArrow(_forest, links.schema), "cc").filter("a <> b")
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        links = written(_star(_star(links, True), False), "cc")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
