import collections
import math
import os
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from riskbands.llm import common, mixing, pii, quality
from riskbands.session import checkpoint_root
from tests.llm.test_encoding import BYTES
from tests.llm.test_similarity import plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(odd_rows):
    """Odd rows, and enough ordinary ones that most pass: prose of its own words, copies, near copies, null ids."""
    rows = [(*r, *[None] * (4 - len(r)))[:4] if len(r) > 2 else (*r, "en", "s1") for r in odd_rows]
    for k in range(100, 140):
        words = [f"word{(j * (k + 7)) % 97}x{j % 13}{chr(97 + (j * k) % 23)}" for j in range(60 + k % 9)]
        rows.append((k, " ".join(words) + ".", "en" if k % 3 else "de", f"s{k % 4}"))
    rows += [(r[0] + 1000, r[1] + " end", r[2], r[3]) for r in rows[-6:]] + [(None, rows[-1][1], "en", "s1")] * 2
    rows += [(None, f"nameless number {k} " + " ".join(f"n{k}w{j}" for j in range(70)), "en", "s2") for k in range(3)]
    rows += [(rows[-1 - k][0] or 5000 + k, f"mail me at p{k}@example.org " + " ".join(f"m{k}w{j}" for j in range(60)), "en", None) for k in range(3)]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def stage(spark, k, docs):
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    return common.written(out, f"test-stage-{k}")


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def files_below(root):
    path = re.sub("^file:/*", "/", root)
    return sorted(os.listdir(os.path.join(path, "riskbands"))) if os.path.isdir(os.path.join(path, "riskbands")) else []


def test_each_stage_against_a_plain_version(spark, corpus):
    docs = common.written(documents(spark, corpus), "test-docs")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    # 1: rows that the rules keep; those with under 50 words or mostly repeated ones never
    one = stage(spark, 0, docs)
    kept = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert one.columns == COLUMNS
    assert bag(one.collect()) == bag(r for r in docs.collect() if r.doc_id in kept and len((r.text or "").split()) >= 50)
    # 2: of each component the first row
    before = [tuple(r) for r in one.collect()]
    two = stage(spark, 1, one)
    component = {r: c for r, (_, _, c) in zip(before, plain_components([r[:2] for r in before]), strict=True)}
    groups = collections.defaultdict(list)
    for r in before:
        groups[component[r]].append(r)
    after = [tuple(r) for r in two.collect()]
    assert len(after) == len(set(after)) and set(after) <= set(before)
    for c, rows in groups.items():
        if c is not None:
            assert [r for r in after if component[r] == c] == [min((r for r in rows if r[0] is not None), key=lambda r: r[0])]
    assert {r for r in after if component[r] is None} == set(groups.get(None, []))
    # 3: texts with personal data replaced by its kind
    three = stage(spark, 2, two)
    spans = {r.doc_id: r.spans for r in pii.find_pii(two).collect()}
    for r in three.collect():
        if r.doc_id is None:
            continue
        text = next(x[1] for x in after if x[0] == r.doc_id)
        for kind, a, b in sorted((s.split(":") for s in spans[r.doc_id].split(",") if s), key=lambda s: -int(s[1])):
            text = text[:int(a)] + f"<{kind}>" + text[int(b):]
        assert len(r.text) <= len(text) + 20 and ("@" in text) == ("@" in r.text)
    assert three.count() == two.count() and three.columns == COLUMNS
    # 4: each row as often as the mix takes it
    four = stage(spark, 3, three)
    taken = {(r.doc_id, r.source): (r.taken, r.size) for r in mixing.mix(three).collect() if r.doc_id is not None}
    times = collections.Counter((r.doc_id, r.source) for r in four.collect() if r.doc_id is not None)
    for key, (words, size) in taken.items():
        assert times[key] == (math.ceil(words / size) if size else 0)
    nameless = collections.Counter(r.text for r in four.collect() if r.doc_id is None)
    assert all(n <= 2 for n in nameless.values())
    # 5: token ids of every row
    five = corpus_pipeline.STAGES[4][1](spark, four, "").collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        __import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))})
    want = collections.Counter(tuple(own.encode_ordinary(r.text)) for r in four.collect())
    assert collections.Counter(tuple(np.frombuffer(r.ids, np.uint32).tolist()) for r in five) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in five)


def test_run_leaves_only_what_its_result_reads(spark, corpus, tmp_path):
    documents(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    root = checkpoint_root(spark)
    before = set(files_below(root))
    out = corpus_pipeline.run(spark, str(tmp_path))
    there = set(files_below(root)) - before
    assert {x.rsplit("-", 1)[0] for x in there} == {"llm-pipeline-3"}, there
    assert out.count() > 20
    common.discard(out)
    assert set(files_below(root)) == before


def test_a_stage_keeps_the_rows_that_its_caller_stored(spark, corpus):
    root = checkpoint_root(spark)
    docs = common.written(documents(spark, corpus), "test-caller")
    stored = {x for x in files_below(root) if x.startswith("llm-test-caller")}
    corpus_pipeline.STAGES[4][1](spark, docs, "")
    corpus_pipeline.STAGES[4][1](spark, documents(spark, corpus), "")  # a later run starts
    assert stored and stored <= set(files_below(root))
    assert docs.count() == len(corpus)
    common.discard(docs)


def test_a_failed_run_leaves_nothing(spark, corpus, tmp_path, monkeypatch):
    documents(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    root = checkpoint_root(spark)
    before = set(files_below(root))

    def broken(*_):
        raise RuntimeError("no")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path))
    assert set(files_below(root)) == before


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "n_tokens" in out.columns


def test_stages_written_by_themselves_keep_what_the_next_reads(spark, corpus):
    """A stage deletes what the one before wrote for itself, but nothing that its own input reads."""
    docs = documents(spark, corpus)
    lazy = corpus_pipeline.STAGES[0][1](spark, docs, "")
    second = corpus_pipeline.STAGES[1][1](spark, lazy, "")  # the unsaved result of a stage
    assert second.count() > 10
