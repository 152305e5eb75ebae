"""Operator 7: token-id files with frequency-ranked ids in byte-aligned variable-length coding.

``encode`` tokenises whole texts with the tokenizers library, its settings as the file gives them (so an added
token's string in a text is that token). White space separates words for this tokenizer, so the words
are cut into its pieces and each distinct piece is encoded once and kept in a bounded cache. ``write`` counts every id over
all documents, gives the most frequent ids the lowest ranks, sorts the documents by id across the cluster
(range partitioning) and packs them in blocks: a control stream holds two bits for each rank (its length of
1 to 4 bytes), a separate data stream the bytes. ``read`` takes the files alone and decodes four ranks a
control byte through a lookup table.

Files are Parquet tables written by Spark's committer: ``blocks`` (file number and order, documents, tokens,
the two streams, tokens of the file before the block) and ``ranks`` (rank -> id). A retried task writes the
same bytes again, and only a committed attempt counts. A block closes at BLOCK_TOKENS tokens, after whole
documents. Only the rank table (at most the vocabulary) and one total per file travel beside the data.

Defined cases: null text is the empty text, which has the end id alone; null doc_ids come first; rows with
equal doc_id are ordered by their ids; repeated rows are stored once each; an empty table writes no blocks;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskbands.llm.bpe import in_chunks
from riskbands.llm.common import shuffles_dropped, written
from riskbands.session import scratch_path

CACHE_WORDS = 500_000
LONGEST_CACHED = 64
CHUNK_BYTES = 4 << 20
BLOCK_TOKENS = 1 << 18


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(others)}}


#: Kinds of the bytes of words whose pieces are found here, printing ASCII and the letters from À to ÿ, which no normal
#: form changes: 1 letters, 2 digits, 3 the others. The letters from À on are 0xC3 and a second byte.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 3
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
KINDS[0x30:0x3A] = 2
#: Lower case of a first byte, and of the byte after 0xC3.
LOWER, LOWER_SECOND = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_SECOND[0x80:0x9F] += 0x20


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the words' bytes one after another, where each word begins and the last one ends)."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def kinds_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the kind of each byte, 0 where it makes its word one for the library; the places after a 0xC3)."""
    kinds, second = KINDS[flat], np.flatnonzero(flat == 0xC3) + 1
    kinds[second] = (flat[second] & 0xDF) != 0x97  # but for × and ÷
    return kinds, second


def piece_starts(lower: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte: the tokenizer's split of lower-cased words into
    's, 't, 're, 've, 'm, 'll, 'd, runs of letters, single digits and runs of the rest."""
    cut = np.ones(len(lower) + 1, bool)
    cut[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    cut[offsets] = True
    quotes = np.flatnonzero(lower == 0x27)
    quotes = quotes[cut[quotes]]
    room = offsets[np.searchsorted(offsets, quotes, "right")] - quotes - 1
    first, second = (np.append(lower, [0, 0])[quotes + k] for k in (1, 2))
    one = (room >= 1) & np.isin(first, list(b"stmd"))
    two = (room >= 2) & np.isin(256 * first.astype(np.int32) + second, [256 * a + b for a, b in (b"re", b"ve", b"ll")])
    for chosen, letters in ((one, 1), (two, 2)):
        cut[quotes[chosen] + 1] = False
        cut[quotes[chosen] + 1 + letters] = True
    return cut[:-1]


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of each stretch one after another, where each begins there and the last one ends)."""
    after = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(starts - after[:-1], sizes)
    place += np.arange(after[-1])
    return ids[place], after


def joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the packed ids one after another, where each one's begin and the last one's end)."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return np.frombuffer(b"".join(packed), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


class Words:
    """The ids of the words of a chunk of texts.

    Arrow splits a chunk's texts at white space, numpy its words into pieces, and Arrow numbers the distinct pieces,
    which words share; the texts' ids are gathered by number. The new pieces of a chunk go to the library as one
    text. In a vocabulary with word ends each piece's last id shows that it is the last, so the ids are cut there.
    Words of other characters, or with an added token in them, go to it by themselves. Both are kept for later
    chunks; too many words are emptied, and of too many pieces those stay that are met again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model on pieces that are normalised, split and spelt in the byte-level alphabet already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def packed(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def learn(self, pieces: list[bytes]) -> None:
        """Add new pieces: one text, cut after the ids that end a piece."""
        if not pieces:
            return
        spelt = b" ".join(pieces).decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.uint32)
        flat, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        self.pieces.update((p, flat[a:b]) for p, a, b in zip(pieces, [0, *ends[:-1]], ends, strict=True))

    def plain_ids(self, flat: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's begin and the last one's end) of plain words."""
        lower = LOWER[flat]
        lower[second] = LOWER_SECOND[flat[second]]
        cut = piece_starts(lower, kinds, offsets)
        at = np.append(np.flatnonzero(cut), len(lower)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(lower)]).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > CACHE_WORDS:
            self.older, self.pieces = self.pieces, {}
        found = list(map(self.pieces.get, pieces))
        if None in found:
            missing = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
            self.pieces.update((p, self.older[p]) for p in missing if p in self.older)
            self.learn([p for p in missing if p not in self.older])
            found = list(map(self.pieces.get, pieces))
        ids, ends = joined(found)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, after = gathered(ids, ends[codes], np.diff(ends)[codes])
        return ids, after[np.concatenate([[0], np.cumsum(cut, dtype=np.int32)])[offsets]]

    def odd_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that the library gets as they are."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.odd) > CACHE_WORDS:
            self.odd.clear()
        new = [w for w in distinct if w not in self.odd]
        fresh = dict(zip(new, self.packed(new), strict=True))
        self.odd.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_CACHED)
        ids, ends = joined([fresh[w] if w in fresh else self.odd[w] for w in distinct])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return gathered(ids, ends[codes], np.diff(ends)[codes])

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words."""
        flat, offsets = flat_bytes(words)
        kinds, second = kinds_of(flat)
        before = np.searchsorted(np.flatnonzero(kinds == 0), offsets)
        plain = before[1:] == before[:-1]
        text = flat.tobytes()
        for token in self.added:
            if token.encode() in text:
                plain &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        if plain.all():
            return self.plain_ids(flat, offsets, kinds, second)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, offsets = flat_bytes(words.filter(pa.array(plain)))
        ids, after = self.plain_ids(flat, offsets, *kinds_of(flat))
        starts[plain], sizes[plain] = after[:-1], np.diff(after)
        odd, after = self.odd_ids(words.filter(pa.array(~plain)))
        starts[~plain], sizes[~plain] = after[:-1] + len(ids), np.diff(after)
        return gathered(np.concatenate([ids, odd]), starts, sizes)

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The packed ids of each text (null: empty), ``end`` appended."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))  # no token holds ASCII white space
        ids, after = self.ids_of(lists.flatten())
        stops = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = after[stops]
        if end is not None:
            ids = np.insert(ids, ends[1:], end)
            ends += np.arange(len(ends))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])


@lru_cache(2)
def _words(path: str) -> Words:
    return Words(path)


def encode(docs: DataFrame, path: str, end: int | None = None, text: str = "text") -> DataFrame:
    """(doc_id, ids): packed little-endian unsigned 32-bit ids, ``end`` appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for part in in_chunks(batch, "__text", CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), words.encode(part.column("__text"), end)],
                                                 ["doc_id", "ids"])

    kept = docs.select("doc_id", docs[text].alias("__text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids binary")


#: Lengths of the four ranks of each control byte, their longest, and which bytes of integers of 1, 2 or 4 bytes are kept.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
LONGEST = LENGTHS.max(axis=1)
KEPT = {w: (np.arange(w) < LENGTHS[:, :, None]).reshape(256, 4 * w) for w in (1, 2, 4)}


def kept_bytes(control: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """(bytes of the integers that hold n ranks, the places of those that are kept)."""
    width = (1, 1, 2, 4, 4)[LONGEST[control].max(initial=1)]
    return width, np.flatnonzero(KEPT[width][control].ravel()[:width * n])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two bits for each rank's length less one, lowest first; the ranks' low bytes."""
    codes = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    for least in (1 << 8, 1 << 16, 1 << 24):
        codes.reshape(-1)[:len(ranks)] += ranks >= least
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width, kept = kept_bytes(control, len(ranks))
    return control.tobytes(), ranks.astype(f"<u{width}").view(np.uint8)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    width, kept = kept_bytes(np.frombuffer(control, np.uint8), n)
    out = np.zeros(width * n, np.uint8)
    out[kept] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").astype(np.uint32)


def rank_table(tokens: DataFrame) -> DataFrame:
    """(id, rank) by falling count over all documents, then by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in in_chunks(batch, "ids"):
                found = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), np.uint32))
                if len(found) > len(total):
                    found, total = total, found.astype(np.int64)
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "id")  # a row for each id of the vocabulary
    return counts.select("id", (F.row_number().over(order) - 1).cast("long").alias("rank"))


def _blocks(by_id: np.ndarray, doc_type: pa.DataType):
    fields = {"file": pa.int32(), "before": pa.int64(), "doc_ids": pa.list_(doc_type), "sizes": pa.list_(pa.int64()),
              "control": pa.binary(), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            control, data = pack(by_id[np.concatenate(parts)])
            row = [file, before, docs, [len(p) for p in parts], control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields.values(), strict=True)],
                                              list(fields))

        for batch in batches:
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(packed, np.uint32))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    before, docs, parts, held = before + held, [], [], 0
        if parts:
            yield block()

    return run


def write(tokens: DataFrame, path: str) -> None:
    """Write the (doc_id, ids) rows below ``path`` in ascending doc_id order."""
    spark = tokens.sparkSession
    with shuffles_dropped(spark):
        rank_table(tokens).write.parquet(f"{path}/ranks")
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # at most the vocabulary
    by_id = np.zeros(1 + max((r.id for r in ranks), default=0), np.uint32)
    for r in ranks:
        by_id[r.id] = r.rank
    kind = tokens.schema["doc_id"].dataType
    doc_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    schema = (f"file int, before long, doc_ids array<{kind.simpleString()}>, sizes array<long>, "
              "control binary, data binary")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    with shuffles_dropped(spark):
        ordered.mapInArrow(_blocks(by_id, doc_type), schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files alone; ``start``: ids of all documents before it."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    ids_of = np.zeros(1 + max((r.rank for r in ranks), default=0), np.uint32)
    for r in ranks:
        ids_of[r.rank] = r.id
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    first = written(totals.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")),
                    "token-files")
    rows = blocks.join(first, F.col("file") == F.col("__file")).select(
        (F.col("__first") + F.col("before")).alias("start"), "doc_ids", "sizes", "control", "data")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes = np.array(row["sizes"].as_py(), np.int64)
                ids = ids_of[unpack(row["control"].as_py(), row["data"].as_py(), int(sizes.sum()))]
                stops = np.cumsum(sizes)
                parts = [ids[a:b].tobytes() for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(row["start"].as_py() + stops - sizes), pa.array(sizes),
                     pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return rows.mapInArrow(run, schema)


def write_and_read(tokens: DataFrame) -> DataFrame:
    """The rows of :func:`read` after writing ``tokens`` to a fresh folder."""
    spark = tokens.sparkSession
    path = scratch_path(spark, "llm-token-files")
    write(tokens, path)
    return read(spark, path)
