"""Operator 13: ranked lexical search, term at a time with limited accumulators.

Documents are ranked for each item by the integer weights of a BM25 form (see :func:`weights`, :func:`impact`).

1. **Index.** One pass over the documents writes, for each block of them, the posting lists of the items' terms
   (documents by place in the block, occurrences) with every document's number of terms.
2. **Statistics.** Number of documents, sum of their terms and each term's document frequency are counted over all
   blocks by Spark aggregates.
3. **Search.** Each block works through an item's terms, rarest first. A document first met gets an accumulator.
   Once the bounds of the remaining terms (weight times the block's best impact) sum to less than the kth
   partial score, or than the kth score that earlier blocks of the task have reached, a document without an
   accumulator can't come among the best any more: none is created from there on, the surviving ones are
   updated exactly, and those that can't reach the kth score either are let go.
4. The best ``k`` of every task are merged per item by a window whose limit is applied before the shuffle.

Blocks hold about BLOCK_BYTES of text, a longer text alone. Items are taken in rounds of about ITEM_BYTES of text,
each with its own index, so what is sent to the tasks is bounded however many items there are; the rounds' results
are a union.

Defined cases: null and empty texts have no terms, count in no statistic and are found by nothing; items without
terms, or whose terms no document holds, give no rows; rows of equal item_id and text are one item, rows of one
item_id with different texts are ranked apart; repeated documents are ranked each; a null doc_id comes last among
equal scores; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import written

TOP = 20
BLOCK_BYTES = 8 << 20
ITEM_BYTES = 8 << 20

#: Bytes of terms: ASCII letters (A-Z lower-cased), digits and everything beyond ASCII; the others separate.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms each: 100 - 25 + (25 n N) div L, in 64-bit integers."""
    return 75 + 25 * n * docs // max(total, 1)


POSTINGS = ("ids array<{id}>, n array<bigint>, term array<int>, places array<binary>, counts array<binary>")


def index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row per block: its documents with terms (ids, n), and posting lists of the vocabulary's terms.

    ``term`` holds places in the vocabulary; ``places`` and ``counts`` the packed 32-bit places of the documents
    in the block, ascending, and the occurrences there.
    """
    kept = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    schema = T.StructType.fromDDL(POSTINGS.format(id=kept.schema["doc_id"].dataType.simpleString()))
    of = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = of.value
        known = places.keys()
        for batch in batches:
            for part in in_chunks(batch, "__text", BLOCK_BYTES):
                filled, sizes, owners, found, times = [], [], [], [], []
                for k, text in enumerate(part.column("__text").to_pylist()):
                    words = terms(text)
                    if not words:
                        continue
                    counted = Counter(filter(known.__contains__, words))
                    owners.append(np.full(len(counted), len(filled), np.int32))
                    found.append(np.fromiter(map(places.__getitem__, counted), np.int32, len(counted)))
                    times.append(np.fromiter(counted.values(), np.int32, len(counted)))
                    filled.append(k)
                    sizes.append(len(words))
                owner, term, tf = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (owners, found, times))
                order = np.argsort(term, kind="stable")
                owner, term, tf = owner[order], term[order], tf[order]
                names, starts = np.unique(term, return_index=True)
                cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True)) if len(names) else []
                row = {"ids": part.column("doc_id").take(pa.array(filled, pa.int64())).to_pylist(), "n": sizes,
                       "term": names.tolist(), "places": [owner[a:b].tobytes() for a, b in cuts],
                       "counts": [tf[a:b].tobytes() for a, b in cuts]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[f]], type=pa.list_(kind)) for f, kind in
                     (("ids", part.column("doc_id").type), ("n", pa.int64()), ("term", pa.int32()),
                      ("places", pa.binary()), ("counts", pa.binary()))], schema.names)

    return kept.mapInArrow(run, schema)


def weights(postings: DataFrame) -> tuple[int, int, dict[int, tuple[int, int]]]:
    """N, L and per term of the vocabulary (df, w): w = floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    sums = postings.agg(F.sum(F.size("n").cast("long")),
                        F.sum(F.expr("aggregate(n, 0L, (s, x) -> s + x)"))).first()
    docs, total = int(sums[0] or 0), int(sums[1] or 0)
    each = postings.select(F.explode(F.arrays_zip("term", F.transform("places", F.octet_length).alias("bytes"))).alias("e"))
    df = (F.sum(F.col("e.bytes").cast("long")) / 4).cast("long")
    each = each.groupBy(F.col("e.term").alias("term")).agg(df.alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return docs, total, {r.term: (r.df, r.w) for r in each.select("term", "df", w.alias("w")).toLocalIterator()}


def search_block(queries: list[list[tuple[int, int, int]]], best: dict[int, list], block: dict, docs: int, total: int,
                 k: int) -> None:
    """Bring the ``best`` (score, place among equals, id) of each query up to date with one block.

    A query lists (term, w, occurrences in the item), rarest first.
    """
    m = length_factor(np.array(block["n"], np.int64), docs, total)
    lists = {}
    for term, places, counts in zip(block["term"], block["places"], block["counts"], strict=True):
        at = np.frombuffer(places, np.int32)
        worth = impact(np.frombuffer(counts, np.int32).astype(np.int64), m[at])
        lists[term] = at, worth, int(worth.max())
    ids = block["ids"]
    for q, query in enumerate(queries):
        held = [(w * times, *lists[term]) for term, w, times in query if term in lists and w > 0]
        if not held:
            continue
        bounds = np.cumsum([factor * most for factor, _, _, most in held][::-1])[::-1].tolist() + [0]
        known = best.get(q, [])
        reached = known[-1][0] if len(known) == k else 0
        partial = np.zeros(len(m), np.int64)
        alive = np.zeros(len(m), bool)
        creating = True
        for j, (factor, at, worth, _) in enumerate(held):
            if creating and bounds[j] < reached:
                creating = False
                alive &= partial + bounds[j] >= reached
            if not creating:
                keep = alive[at]
                if not keep.any():
                    continue
                at, worth = at[keep], worth[keep]
            else:
                alive[at] = True
            partial[at] += factor * worth
            now = partial[alive]
            if len(now) >= k:
                reached = max(reached, int(np.partition(now, len(now) - k)[len(now) - k]))
        place = np.flatnonzero(alive & (partial >= max(reached, 1)))
        fresh = [(s, ids[p]) for s, p in zip(partial[place].tolist(), place.tolist(), strict=True)]
        best[q] = sorted([*known, *fresh], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]


def search(postings: DataFrame, queries: list[list[tuple[int, int, int]]], docs: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best k of each task for every query."""
    kind = postings.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind),
                           T.StructField("score", T.LongType())])
    sent = postings.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):
                search_block(sent.value, best, batch.slice(at, 1).to_pylist()[0], docs, total, k)
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        if rows:
            q, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())],
                                             schema.names)

    return postings.mapInArrow(run, schema)


def rounds(items: DataFrame) -> Iterator[DataFrame]:
    """The distinct items in parts of about ITEM_BYTES of text."""
    items = written(items.select("item_id", "text").filter("text IS NOT NULL").distinct(), "search-items")
    held = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-held // ITEM_BYTES)
    for r in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == r) if n > 1 else items


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Per item its k best documents: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("query", T.IntegerType()), items.schema["item_id"]])
    parts = []
    for part in rounds(items):
        rows = [(r.item_id, Counter(terms(r.text.encode()))) for r in part.toLocalIterator()]
        vocabulary = sorted(set().union(*(c for _, c in rows)))
        if not vocabulary:
            continue
        postings = written(index(docs, vocabulary), "search-index", "zstd")
        n, total, weighted = weights(postings)
        place = {t: p for p, t in enumerate(vocabulary)}
        queries = [sorted(((place[t], weighted[place[t]][1], times) for t, times in c.items() if place[t] in weighted),
                          key=lambda x: (weighted[x[0]][0], x[0])) for _, c in rows]
        found = search(postings, queries, n, total, k)
        by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        named = written(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], schema), "search-names")
        parts.append(found.join(named, "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        none = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"],
                             T.StructField("score", T.LongType())])
        return spark.createDataFrame([], none)
    return reduce(DataFrame.unionByName, parts)
