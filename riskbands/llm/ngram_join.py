"""Operator 8: n-gram Jaccard join with filters under several global orders.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least the threshold.
Every link between different sets is found or implied by the components, without approximation:

1. One pass hashes the shingles. Documents with equal sets form a class (128-bit digest of the set).
2. Order one is by hash. Sets that link differ in few tokens, so among the first ``n - ceil(t n) + m`` tokens
   by hash of each, the two share at least ``m``; m = min(SLACK, ceil(t n)) there.
3. These prefixes are dealt out by token. Tokens that only one class holds drop out, the others get their
   number of holders.
4. Order two is by that number, then by hash. Two classes share m tokens, so they share one of the
   ``s - m + 1`` rarest of each one's s remaining tokens: passages that very many documents hold come last in
   every set and bring no candidates, unless nearly the whole set is such a passage.
5. Candidates share a token of that prefix and pass the length and positional filters, and a parity bitmap: each
   set has SIGNATURE words of 64 bits, in which every token turns one bit over. Bits that differ are tokens that
   only one set holds, so sets with more such bits than linked sets can have are no pair; near copies just below
   the threshold end here, inside the join. They must also share enough tokens of the prefixes under order one,
   and a prefix token under order three (the descending hashes), before the whole sets are intersected.
6. A token held by many classes doesn't pair them all. Every holder is compared with one pivot of the token;
   links merge components, and holders in other components than the next SEATS pivots are compared again. Once
   a round links less than FRUITFUL as many pairs as there are classes, all pairs that still lie in two components and
   pass the filters are compared.

A token that is frequent within a chunk of a task is set aside there (its holders are known to share it) and
announced to the others, so no window group holds a token of a large share of all rows.

Every table here grows with the input, so all joins are by sort and merge: none goes through the driver's memory.

Defined cases: documents without words or with null text have no shingles, are their own component and link
with nothing; repeated rows and equal sets are one class; a null doc_id never becomes a component id unless
all of the component's ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import discard, merge_join, scratch, written
from riskbands.llm.components import components

WIDTH = 5
PERCENT = 80
SLACK = 160
CHUNK_BYTES = 8 << 20
CACHE_WORDS = 400_000
HOT_SHARE = 0.05  # of a chunk's documents, and at least
HOT_LEAST = 64
HOT_SLOTS = 64
FRUITFUL = 0.02
SEATS = 32
SIGNATURE = 16
BITS = [f"g{k}" for k in range(SIGNATURE)]
MOST = (1 << 62)
_K = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles as signed integers."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    span = min(width, len(found))
    out = np.full(len(found) - span + 1, span, np.uint64)
    for k in range(span):
        out = out * _K + h[k:len(h) - span + 1 + k]
    return np.unique(mixed(out).view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _features(id_field: T.StructField, percent: int, width: int, slack: int):
    schema = T.StructType([
        T.StructField("doc_id", id_field.dataType), T.StructField("thash", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("pre", T.ArrayType(T.LongType())),
        T.StructField("hot", T.ArrayType(T.LongType())), T.StructField("mark", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        empty = np.zeros(0, np.int64)
        for batch in batches:
            for part in in_chunks(batch, "__text", CHUNK_BYTES):
                sizes, nodes, prefixes = [], [], []
                for text in part.column("__text").to_pylist():
                    s = shingles(text, hashes, width)
                    sizes.append(n := len(s))
                    nodes.append(node := xxhash.xxh128_digest(s.tobytes()) if n else None)
                    fresh = n and node not in seen  # a class sends its prefix once from each task
                    if fresh:
                        seen.add(node)
                    prefixes.append(s[:n - least_overlap(n, percent) + slack] if fresh else empty)
                values = np.concatenate([empty, *prefixes])
                ends = np.cumsum([len(p) for p in prefixes])
                tokens, counts = np.unique(values, return_counts=True)
                marks = tokens[counts >= max(HOT_LEAST, HOT_SHARE * len(sizes))]
                hot = np.isin(values, marks) if len(marks) else np.zeros(len(values), bool)
                passed = np.concatenate(([0], np.cumsum(hot)))
                hot_ends = passed[ends] if len(ends) else ends

                def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))

                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("thash"), pa.array(sizes, pa.int64()),
                     pa.array(nodes, pa.binary()), lists(values[~hot], ends - hot_ends), lists(values[hot], hot_ends),
                     lists(marks, np.full(len(sizes), len(marks)))], schema.names)  # the first row announces them

    return run, schema


def features(docs: DataFrame, percent: int, width: int, slack: int) -> DataFrame:
    """Per document: its set's size and digest, and the tokens of its prefix under order one."""
    run, schema = _features(docs.schema["doc_id"], percent, width, slack)
    return docs.select("doc_id", F.xxhash64("text").alias("thash"), F.col("text").alias("__text")).mapInArrow(run, schema)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: SIGNATURE signed 64-bit words, a bit set where an odd number of tokens falls."""
    odd = np.bincount((tokens.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(node, n, set) and the words of the parity bitmap: the sorted sets, packed."""
    schema = "node binary, n long, set binary, " + ", ".join(f"{g} long" for g in BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in in_chunks(batch, "__text", CHUNK_BYTES):
                sets = [shingles(t, hashes, width) for t in part.column("__text").to_pylist()]
                packed = [s.tobytes() for s in sets]
                bits = np.array([signature(s) for s in sets], np.int64).reshape(-1, SIGNATURE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh128_digest(p) for p in packed], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(packed, pa.binary()),
                     *[pa.array(np.ascontiguousarray(c)) for c in bits.T]], ["node", "n", "set", *BITS])

    return docs.select(F.col("text").alias("__text")).mapInArrow(run, schema)


def common(a: bytes, b: bytes) -> int:
    """Number of tokens in both of two packed sets."""
    return len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True))


def similar(a: bytes, b: bytes, percent: int, slack: int) -> bool:
    """Whether two packed sets reach the threshold; their prefixes under orders one and three filter first.

    Sets that link share at least min(slack, ceil(t n)) of their first tokens for the larger n, and one of their last.
    """
    x, y = len(a) // 8, len(b) // 8
    need = least_overlap(max(x, y), percent)
    first, second = (s[:8 * (n - least_overlap(n, percent) + slack)] for s, n in ((a, x), (b, y)))
    if common(first, second) < min(slack, need):
        return False
    if not common(a[8 * (least_overlap(x, percent) - 1):], b[8 * (least_overlap(y, percent) - 1):]):
        return False
    both = common(a, b)
    return 100 * both >= percent * (x + y - both)


def _both(a: str, b: str, percent: int) -> Column:
    """The least number of tokens that two sets of sizes ``{a}n`` and ``{b}n`` share if they link."""
    return F.ceil((F.col(f"{a}n") + F.col(f"{b}n")) * percent / F.lit(100.0 + percent) - 1e-6).cast("long")


def _near(a: str, b: str, percent: int) -> Column:
    """Whether the parity bitmaps of two sets differ in no more bits than tokens can be in only one of them."""
    apart = sum((F.bit_count(F.col(f"{a}{g}").bitwiseXOR(F.col(f"{b}{g}"))) for g in BITS), F.lit(0))
    return apart <= F.col(f"{a}n") + F.col(f"{b}n") - 2 * _both(a, b, percent)


def beside(rows: DataFrame, sets: DataFrame, key: str, prefix: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of the set named in ``key``, under names that begin with ``prefix``."""
    marks = sets.select(F.col("node").alias("__node"), *[F.col(c).alias(prefix + c) for c in columns])
    return merge_join(rows, marks, F.col(key) == F.col("__node")).drop("__node")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, slack: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: the parity bitmaps are compared first, then the sets."""
    marked = beside(beside(pairs, sets, "a", "a_", ["n", *BITS]), sets, "b", "b_", ["n", *BITS])
    likely = marked.filter(_near("a_", "b_", percent)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = [similar(x, y, percent, slack) for x, y in zip(batch.column("a_set").to_pylist(),
                                                                   batch.column("b_set").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(holds, pa.bool_()))

    whole = beside(beside(likely, sets, "a", "a_", ["set"]), sets, "b", "b_", ["set"])
    return whole.mapInArrow(run, "a binary, b binary")


def shared_tokens(feats: DataFrame) -> DataFrame:
    """(token, short, held): tokens of prefixes that several classes hold, with the number of holders."""
    # slot 0: a token's rows from chunks where it is rare, and its announcements (slot -1) from the others;
    # further slots: its rows from chunks where it is frequent, dealt out by class
    def slotted(column: str, slot: Column) -> Column:
        return F.transform(column, lambda t: F.struct(t.alias("token"), slot.alias("slot")))

    spread = (F.pmod(F.xxhash64("node"), F.lit(HOT_SLOTS)) + 1).cast("int")
    sent = F.concat(slotted("pre", F.lit(0)), slotted("hot", spread), slotted("mark", F.lit(-1)))
    rows = feats.select(F.explode(sent).alias("e"), F.substring("node", 1, 8).alias("short"))
    rows = rows.select("e.token", F.greatest("e.slot", F.lit(0)).alias("slot"),
                       F.when(F.col("e.slot") >= 0, F.col("short")).alias("short"))
    own = Window.partitionBy("token", "slot")
    rows = rows.select("token", "slot", "short", F.count("short").over(own).alias("held"),
                       F.count("*").over(own).alias("sent"),
                       (F.min("short").over(own) != F.max("short").over(own)).alias("several"))
    hot = (F.col("slot") > 0) | (F.col("sent") > F.col("held"))
    rows = rows.filter(F.col("short").isNotNull() & (hot | F.col("several")))
    return rows.select("token", "short", F.when(hot, F.lit(MOST)).otherwise(F.col("held")).alias("held")).distinct()


def _overlap(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0)).cast("long")


def candidates(feats: DataFrame, classes: DataFrame, percent: int, slack: int) -> DataFrame:
    """(token, node, n, s, at): each class's prefix under order two; ``at`` is the place among its s tokens."""
    rows = written(shared_tokens(feats), "ngram-shared")
    rows = merge_join(rows, classes.select(F.substring("node", 1, 8).alias("short"), "node", "n"), "short")
    least = F.least(F.lit(slack), _overlap(F.col("n"), percent))
    of = Window.partitionBy("node")
    rows = rows.select("token", "node", "n", "held", least.alias("m"), F.count("*").over(of).alias("s"))
    rows = rows.filter("s >= m").withColumn("at", F.row_number().over(of.orderBy("held", "token")))
    rows = rows.filter("at <= s - m + 1").select("token", "node", "n", "s", "at")
    several = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    return merge_join(rows, several, "token").drop("c")


def _possible(a: str, b: str, percent: int, slack: int) -> Column:
    """Whether two classes can link that meet at a token: by their sizes, and by the tokens from there on.

    Sets link with an intersection of at least o = t (n_a + n_b) / (1 + t). A prefix leaves out at most
    ceil(t n) - m of a set's tokens, so o less the larger of these must be shared within the prefixes. If the
    token is the first in order two that both hold, one token and those behind it are all they can share.
    """
    n1, n2, s1, s2, at1, at2 = (F.col(f"{side}{c}") for c in ("n", "s", "at") for side in (a, b))
    cut = F.greatest(F.lit(0), _overlap(F.greatest(n1, n2), percent) - slack)
    both = _both(a, b, percent)
    left = 1 + F.least(s1 - at1, s2 - at2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (left >= both - cut)


def _pairs(rows: DataFrame, a: str, b: str, tried: DataFrame | None) -> DataFrame:
    """Distinct unordered pairs of the nodes in two columns, without those tried before."""
    pairs = rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return written(pairs if tried is None else merge_join(pairs, tried, ["a", "b"], "left_anti"), "ngram-pairs")


def links(docs: DataFrame, feats: DataFrame, classes: DataFrame, percent: int, width: int, slack: int) -> DataFrame | None:
    """(node, root) of every class that links with another one, None if there is none."""
    with scratch(docs.sparkSession) as needed:
        rows = written(candidates(feats, classes, percent, slack), "ngram-candidates")
        needed.append(rows)
    kept = merge_join(rows.select("node").distinct(), classes, "node").select(
        F.col("doc_id").alias("__id"), F.col("thash").alias("__th"))
    holders = docs.select("doc_id", "text", F.xxhash64("text").alias("thash"))
    holders = merge_join(holders, kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("thash") == F.col("__th")))
    sets = written(sets_of(holders, width).dropDuplicates(["node"]), "ngram-sets")
    found, roots, tried, turn, fruitful, now_written = None, None, None, 0, True, None
    size = sets.count()
    while True:
        now = rows.withColumn("label", F.col("node")).withColumn("mass", F.lit(1).cast("long"))
        if roots is not None:
            mass = roots.groupBy("root").agg((F.count("*") + 1).alias("mass"))
            # both sides hold linked nodes only; the root itself isn't listed among them
            known = merge_join(roots.unionByName(mass.select(F.col("root").alias("node"), "root")), mass, "root")
            now = merge_join(rows, known, "node", "left").select(
                *rows.columns, F.coalesce("root", "node").alias("label"), F.coalesce("mass", F.lit(1)).alias("mass"))
            before, now = now_written, written(now, "ngram-labels")
            now_written = now
            if before is not None:
                discard(before)
        if not fruitful:
            break
        # the first round has one pivot a token; later ones, for the few still apart, have several
        seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(SEATS if turn else 1))
        pivots = now.groupBy("token", seat.alias("seat")).agg(
            F.min_by(F.struct("node", "n", "s", "at", "label"), F.xxhash64("node", "token", F.lit(turn))).alias("p"))
        apart = merge_join(now, pivots, "token").filter((F.col("label") != F.col("p.label")) & _possible("", "p.", percent, slack))
        pairs = _pairs(apart, "node", "p.node", tried)
        fresh = written(verified(pairs, sets, percent, slack), "ngram-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        turn += 1
        n_fresh = fresh.count()
        if not n_fresh:
            break
        fruitful = n_fresh >= FRUITFUL * size
        found = fresh if found is None else found.unionByName(fresh)
        roots = components(found)
    # every pair of two components holds a node outside the token's largest one
    largest = now.groupBy("token").agg(F.max_by("label", F.struct("mass", "label")).alias("largest"))
    outside = written(beside(merge_join(now, largest, "token").filter("label <> largest"), sets, "node", "", BITS), "ngram-outside")
    there = merge_join(now, outside.select("token").distinct(), "token", "left_semi")
    there = beside(there, sets, "node", "", BITS)
    other = there.select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "s", "at", "label", *BITS)])
    rest = merge_join(outside, other, "token").filter((F.col("label") != F.col("other_label"))
                                                      & _possible("", "other_", percent, slack) & _near("", "other_", percent))
    fresh = written(verified(_pairs(rest, "node", "other_node", tried), sets, percent, slack), "ngram-links")
    if fresh.isEmpty():
        return roots
    return components(fresh if found is None else found.unionByName(fresh))


def with_component(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """(doc_id, thash, n_shingles, component_id, chosen) per row.

    ``thash`` is the text's hash; ``chosen`` says whether (doc_id, thash) is the component's first (null ids last).
    """
    with scratch(docs.sparkSession) as kept:
        feats = written(features(docs, percent, width, slack), "ngram-features")
        classes = feats.filter("n > 0").groupBy("node").agg(
            F.min("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "thash")).alias("r"))
        classes = written(classes.select("node", "n", "r.doc_id", "r.thash"), "ngram-classes")
        roots = links(docs, feats, classes, percent, width, slack)
        if roots is None:
            named = classes.select("node", F.col("doc_id").alias("component_id"), F.col("thash").alias("first"))
        else:
            rooted = merge_join(classes, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            least = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "thash")).alias("r"))
            named = merge_join(rooted.select("node", "root"), least, "root").select(
                "node", F.col("r.doc_id").alias("component_id"), F.col("r.thash").alias("first"))
        named = written(named, "ngram-components")
        kept += [feats, named]
    out = merge_join(feats.select("doc_id", "thash", F.col("n").alias("n_shingles"), "node"), named, "node", "left")
    chosen = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("thash") == F.col("first")))
    return out.select("doc_id", "thash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      chosen.alias("chosen"))


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that links lead to."""
    return with_component(docs, **options).drop("thash", "chosen")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each component the one with the least doc_id (null last), all those without shingles.

    Rows of equal id and text, a null id being equal to itself, are one document.
    """
    with scratch(docs.sparkSession) as needed:
        kept = with_component(docs, **options).filter("chosen")
        kept = written(kept.select(F.col("doc_id").alias("__id"), F.col("thash").alias("__th")).distinct(), "ngram-kept")
        needed.append(kept)
    known = docs.withColumn("__hash", F.xxhash64("text"))
    known = merge_join(known, kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    return known.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
