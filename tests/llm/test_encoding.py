import base64
import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskbands.llm import bpe, token_files
from riskbands.llm.common import written

BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(BYTES, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


TEXT = st.text(alphabet="ab'stredlvmTS \n\t 12²٣#$é中😀\x1c\x85  ", max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_bpe_equals_reference_on_any_text(texts):
    ranks = bpe.ranks(BYTES)
    with open(BYTES, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    ids, offsets = ranks.encode(texts)
    for text, packed, at in zip(texts, ids, offsets, strict=True):
        assert np.frombuffer(packed, np.uint32).tolist() == want.encode_ordinary(text)
        assert ranks.decode(packed) == text.encode()
        starts = np.frombuffer(at, np.uint32).tolist()
        assert starts == sorted(set(starts)) and (starts[:1] == [0] or not text)


def test_bpe_long_slices_and_emptied_cache(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 3)
    ranks = bpe.Ranks(BYTES)
    texts = ["a" * 3000, "é" * 400, " " * 700 + "x", "ab" * 500, "one two three four five six", ""]
    for text, packed in zip(texts, ranks.encode(texts)[0], strict=True):
        assert np.frombuffer(packed, np.uint32).tolist() == reference.encode_ordinary(text)


def test_bpe_operator_on_odd_rows(make_docs, odd_rows, reference):
    encoded = bpe.encode(make_docs(odd_rows), BYTES)
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.ids)) for r in encoded.collect())
    want = sorted((i is None, i, np.array(reference.encode_ordinary(t or ""), np.uint32).tobytes()) for i, t, *_ in odd_rows)
    assert [g for g in got] == want
    decoded = bpe.decode(encoded, BYTES).collect()
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in decoded) == sorted(
        hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_rows)
    assert bpe.encode(make_docs([]), BYTES).count() == 0


def test_pack_and_unpack():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        ranks = rnd.integers(0, [1 << 8, 1 << 16, 1 << 24, 1 << 32][n % 4], n)
        control, data = token_files.pack(ranks)
        assert (token_files.unpack(control, data, n) == ranks).all() and len(control) == -(-n // 4)


@lru_cache(1)
def unchanged():
    return Tokenizer.from_file(WORDS)


WORD_TEXT = st.lists(st.one_of(
    st.text(alphabet="ab'sStTredlvmM \n\t 12²٣#$éÉñßÄ中Σςİ\u0301😀\x1c\x85\u00a0÷×.,;&-", max_size=12),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "don't", "WE'LL", "x,", "über", "</w>", "e\u0301"])),
    max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(WORD_TEXT, max_size=4))
def test_token_ids_equal_the_library_on_any_text(texts):
    plain = unchanged()
    for text, packed in zip(texts, token_files._words(WORDS).encode(pa.array(texts, pa.string())).to_pylist(), strict=True):
        assert np.frombuffer(packed, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_ids_with_emptied_caches(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 4)
    words = token_files.Words(WORDS)
    for text in ("one two, three? FOUR five's", "six seven <|endoftext|> one", "Two " * 50 + "über-x 12a", ""):
        got = [np.frombuffer(x.as_py(), np.uint32).tolist() for x in words.encode(pa.array([text, None]), 2)]
        assert got == [[*tokenizer.encode(text, add_special_tokens=False).ids, 2], [2]]


def test_a_chunk_asks_for_each_distinct_piece_once(tokenizer):
    asked = []

    class Noted(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    words = token_files.Words(WORDS)
    texts = [f"{'' if n % 2 else '('}Word{c} word's" for n in range(50) for c in ",.;:!?"]
    words.encode(pa.array(texts))  # learns
    words.pieces = Noted(words.pieces)
    got = [np.frombuffer(x, np.uint32).tolist() for x in words.encode(pa.array(texts)).to_pylist()]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == sorted(set(asked))


PLAIN_WORDS = st.lists(st.text(alphabet="aZ'sStTRErevVEmMlLdD09.,×÷ÀÖØÞßàöøÿñ<|", max_size=8), max_size=8)


@settings(max_examples=400, deadline=None)
@given(words=PLAIN_WORDS)
def test_pieces_of_plain_words(words):
    words = [w for w in words if not set(w) & set("×÷")]
    flat, offsets = token_files.flat_bytes(pa.array(["before", *words], pa.string())[1:])
    kinds, second = token_files.kinds_of(flat)
    lower = np.frombuffer("".join(words).lower().encode(), np.uint8)
    cut = np.append(np.flatnonzero(token_files.piece_starts(lower, kinds, offsets)), len(lower))
    got = [lower[a:b].tobytes().decode() for a, b in zip(cut, cut[1:], strict=False)]
    split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")
    assert got == [p for w in words for p in split.findall(w.lower())]
    assert token_files.LOWER_SECOND[flat[second]].tolist() == lower[second].tolist()
    assert (kinds > 0).all() and (token_files.kinds_of(token_files.flat_bytes(pa.array(["×", "÷", "é"]))[0])[0] == [1, 0, 1, 0, 1, 1]).all()


def test_pieces_met_again_outlive_an_emptied_cache(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 2)
    words, learnt = token_files.Words(WORDS), []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    for n in range(6):
        text = f"often seen {chr(97 + n) * 3}"
        assert np.frombuffer(words.encode(pa.array([text]))[0].as_py(), np.uint32).tolist() == tokenizer.encode(text).ids
    assert len(learnt) == len(set(learnt)) == 8 and len(words.pieces) <= 3 + 2


def test_token_files_round_trip(make_docs, odd_rows, tokenizer, monkeypatch):
    rows = [*odd_rows, (30, "hello <|endoftext|> world<|startoftext|>"), (31, "Σίσυφος ΟΔΟΣ, naïve ÀÉÎ don't WE'LL 3rd")]
    docs = make_docs(rows)
    tokens = written(token_files.encode(docs, WORDS, end=2), "test-tokens")
    got = [(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.write_and_read(tokens).collect()]
    at, want = 0, []
    got = sorted(got, key=lambda r: r[0])
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # null ids first
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_of_nothing(make_docs):
    tokens = token_files.encode(make_docs([]), WORDS, end=2)
    assert token_files.write_and_read(tokens).count() == 0


def test_frequent_ids_get_low_ranks(spark):
    rows = [(k, np.array(v, np.uint32).tobytes()) for k, v in enumerate([[7, 7, 7, 5], [7, 9], [5, 300]])]
    ranks = {r.id: r.rank for r in token_files.rank_table(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()}
    assert ranks == {7: 0, 5: 1, 9: 2, 300: 3}
