import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskbands.llm import periodic_runs, queries


def plain_runs(w):
    """Every maximal stretch of smallest period q and length >= max(6, 4 q), tried for each q and start."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            a, b = i, j + q
            smaller = any(all(w[k] == w[k + p] for k in range(a, b - p)) for p in range(1, q))
            if b - a >= max(6, 4 * q) and not smaller:
                out.append((a, b, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = plain_planted(doc_id, text)
    found = plain_runs(w)
    gone = {k for a, b, q in found for k in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    return (doc_id, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_runs_equal_brute_force(data):
    rnd = random.Random(data.draw(st.integers(0, 10**9)))
    w = []
    while len(w) < rnd.choice([10, 120, 400]):
        kind = rnd.random()
        if kind < 0.4:
            w += [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randrange(1, 40))]
        else:
            unit = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randrange(1, rnd.choice([3, 9, 40])))]
            if rnd.random() < 0.3:
                unit = unit * rnd.randrange(2, 6) + [99]
            whole = unit * rnd.randrange(2, 9)
            w += whole[:len(whole) - rnd.randrange(len(unit))]
    assert periodic_runs.runs(np.array(w)) == plain_runs(w)


def test_fibonacci_and_nested_powers():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for w in (b, [0] * 200, ([0] * 9 + [1]) * 30, (([0, 1] * 5 + [2]) * 6 + [3]) * 5):
        assert periodic_runs.runs(np.array(w)) == plain_runs(w)


def test_texts_side_by_side_keep_apart():
    texts = [[b"a"] * 9, [], [b"a"] * 7, [b"x", *[b"a", b"b"] * 5], [b"b", b"a"] * 4]
    assert periodic_runs.runs_of_texts(texts) == [plain_runs(t) for t in texts]


def test_long_periods_and_long_texts():
    rnd = random.Random(3)
    unit = [str(rnd.random()).encode() for _ in range(20_011)]
    assert periodic_runs.runs_of_texts([[b"z", *unit * 4, b"y"], unit]) == [[(1, 80_045, 20_011)], []]
    assert periodic_runs.runs_of_texts([[b"w"] * 500_000]) == [[(0, 500_000, 1)]]


def test_query_equals_brute_force(spark, make_docs, odd_rows, tmp_path):
    rnd = random.Random(8)
    rows = [r for r in odd_rows if r[0] != 4]  # the long one has no run and is slow by the plain way
    for k in range(100, 160):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 150))]
        rows.append((k, " ".join(words + words * rnd.randrange(0, 5))))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(*r[:2]) for r in rows), key=key)


def test_empty_table(spark, make_docs):
    assert periodic_runs.find_runs(periodic_runs.planted(make_docs([]))).collect() == []
