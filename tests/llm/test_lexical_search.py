import math
import random
import re
from collections import Counter

import pytest

from riskbands.llm import lexical_search, queries


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranked(docs, items, k=20):
    held = [(i, Counter(w), len(w)) for i, text in docs if (w := plain_terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((s, i))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.fixture
def corpus(odd_rows):
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(900)]
    rows = [r[:2] for r in odd_rows]
    for k in range(100, 500):
        rows.append((k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120)))))
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30)))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "nowhere"), (54, "Quick QUICK brown w0 w0 é漢字"), (None, "quick w1"),
              (55, "w1 w2"), (55, "w1 w2")]
    return rows, items


def search_items(spark, items):
    return spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, n int")


def test_equals_brute_force(spark, make_docs, corpus, monkeypatch):
    rows, items = corpus
    docs = make_docs(rows).repartition(3)
    want = plain_ranked(rows, dict.fromkeys(items))
    got = lexical_search.ranked(docs, search_items(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("k", [1, 3])
def test_small_blocks_and_rounds_give_the_same(spark, make_docs, corpus, monkeypatch, k):
    rows, items = corpus
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 1500)
    vocabulary = sorted({t.encode() for _, text in items for t in plain_terms(text)})
    whole = [lexical_search.terms(t and t.encode()) for _, t in items]
    assert set(vocabulary) == {t for w in whole for t in w}
    got = lexical_search.ranked(make_docs(rows).repartition(40), search_items(spark, items), k)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranked(rows, dict.fromkeys(items), k)


def test_accumulators_stop(monkeypatch):
    """A document that holds only the common term gets no accumulator once the rare ones fill the best k."""
    block = {"ids": list(range(100)), "n": [10] * 100, "term": [0, 1],
             "places": [bytes(b"".join(i.to_bytes(4, "little") for i in p)) for p in ([7, 9], range(100))],
             "counts": [(1).to_bytes(4, "little") * n for n in (2, 100)]}
    best = {}
    lexical_search.search_block([[(0, 5000, 1), (1, 3, 1)]], best, block, 100, 1000, 2)
    assert [i for _, i in best[0]] == [7, 9] and best[0][0][0] == best[0][1][0]
    plain = 5000 * (10**9 // 2200) + 3 * (10**9 // 2200)
    assert best[0][0][0] == plain


def test_string_ids_and_empty_tables(spark, make_docs, corpus):
    items = search_items(spark, [(1, "fox")])
    docs = spark.createDataFrame([("b", "a fox"), ("a", "a fox"), (None, "a fox"), ("c", "no")], "doc_id string, text string")
    got = [(r["rank"], r.doc_id) for r in lexical_search.ranked(docs, items).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, None)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        empty = lexical_search.ranked(d, i)
        assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_query_reads_both_tables(spark, make_docs, corpus, tmp_path):
    rows, items = corpus
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    search_items(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op13_lexical_search(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranked(rows, dict.fromkeys(items))
