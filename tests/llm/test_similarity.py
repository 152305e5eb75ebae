import collections
import random
import re

import numpy as np
import pytest
import xxhash

from riskbands.llm import common, components, fingerprints, ngram_join


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain_components(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)].append(r[0])
    return [(r[0], len(sets[k]), min(least[root(k)]) if sets[k] and least[root(k)] else r[0]) for k, r in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows, k = [], 0
    while len(rows) < n:
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 8, 30, 120, 400]))]
        if rnd.random() < 0.4:
            base = passage + base
        for _ in range(rnd.choice([1, 1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((k, " ".join(copy)))
            k += rnd.choice([1, 3])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_all_pairs(make_docs, odd_rows, seed):
    rows = corpus(seed) + ([(i if i is None else i + 10**6 if abs(i) < 10**6 else i, *r) for i, *r in odd_rows] if seed == 1 else [])
    got = [tuple(r) for r in ngram_join.ngram_join(make_docs(rows)).collect()]
    assert ordered(got) == ordered(plain_components(rows))


def test_ngram_join_small_slack_and_hot_tokens(make_docs, monkeypatch):
    rows = corpus(3, 120) + [(5000 + k, " ".join(["same"] * 3 + [f"u{k}"] * (k % 3) + [f"p{j}" for j in range(60)])) for k in range(90)]
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 4)
    monkeypatch.setattr(ngram_join, "FRUITFUL", 0.0)
    got = [tuple(r) for r in ngram_join.ngram_join(make_docs(rows).coalesce(2), slack=5).collect()]
    assert ordered(got) == ordered(plain_components(rows))


@pytest.mark.parametrize("fruitful", [0.0, 1.0])
def test_ngram_join_near_the_threshold(make_docs, monkeypatch, fruitful):
    """Copies whose similarity to each other lies on both sides of 0.8, sought by pivots only, or by pairs at once."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(90):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randrange(1, 9)):
            copy[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "FRUITFUL", fruitful)
    got = [tuple(r) for r in ngram_join.ngram_join(make_docs(rows)).collect()]
    assert ordered(got) == ordered(plain_components(rows)) and len({r[2] for r in got}) > 1


def test_signatures_differ_in_no_more_bits_than_the_sets_in_tokens():
    rnd = np.random.default_rng(3)
    for n, m, k in ((0, 0, 0), (5, 3, 2), (200, 30, 40), (3000, 500, 10), (20, 2000, 0)):
        both, a, b = (rnd.integers(-2**63, 2**63, size=x) for x in (n, m, k))
        x, y = (ngram_join.signature(np.unique(np.concatenate([both, z]))) for z in (a, b))
        bits = sum(bin(int(d) & (2**64 - 1)).count("1") for d in x ^ y)
        assert bits <= m + k and (bits >= 0.8 * (m + k) or m + k > 200)
    assert len(x) == ngram_join.SIGNATURE


def test_ngram_join_of_string_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [("b", text), ("a", text + " end"), ("c", "something else entirely different here"), (None, text), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got == {"b": "a", "a": "a", "c": "c", None: "a", "d": "d"}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == ["a", "c", "d"]


def test_no_join_of_ngram_join_goes_through_the_driver(make_docs, monkeypatch):
    """Its tables all grow with the input, and estimates may be far too small: none may be broadcast, however small it looks."""
    plans = []

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, *args)
    for module in (ngram_join, components):
        monkeypatch.setattr(module, "written", noted)
    docs = make_docs(corpus(4))
    for out in (ngram_join.ngram_join(docs), ngram_join.one_of_each(docs)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    links = docs.select((docs.doc_id + 1).cast("string").alias("a"), docs.doc_id.cast("string").alias("b"))
    components.components(links, one_task=0)
    assert sum(p.count("SortMergeJoin") for p in plans) > 20
    assert not [p for p in plans if "Broadcast" in p]


def test_one_of_each(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert ids[7] == 1 and ids[8] == ids[9] == 0 and ids[10] == 1 and ids[11] == 0 and ids[None] == 1 and ids[1] == 1
    assert ngram_join.one_of_each(make_docs([])).count() == 0
    assert ngram_join.ngram_join(make_docs([(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_chain_and_a_star(spark, one_task):
    chain = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("500", f"6{k:02d}") for k in range(50)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(chain, "a string, b string"), one_task).collect()}
    assert all(got[f"{k:03d}"] == "000" for k in range(1, 41)) and all(got[f"6{k:02d}"] == "500" for k in range(50))


def plain_units(text):
    text = text or ""
    single = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"
    letters = re.findall(r"[^\x20\x09-\x0D]", text)
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(f"({single})", r" \1 ", text))
    return letters if len(text) < 120 or len(w) * 40 < len(text) else w


def plain_anchors(text):
    w = plain_units(text)

    def h(data, seed=42):
        x = xxhash.xxh64_intdigest(data, seed)
        return x - (1 << 64) if x >= 1 << 63 else x

    def both(a, b):
        first = h(a) if isinstance(a, bytes) else h((a % (1 << 64)).to_bytes(8, "little"))
        data = b if isinstance(b, bytes) else (b % (1 << 64)).to_bytes(8, "little")
        return h(data, first % (1 << 64))

    if len(w) < 4:
        return [(0, h(" ".join(w).encode()))] if w else []
    q = [both(a.encode(), b.encode()) for a, b in zip(w, w[1:], strict=False)]
    return [(k, both(q[k], q[k + 2])) for k in range(len(w) - 3) if min(q[k], q[k + 2]) <= q[k + 1]]


def test_anchors_against_plain_version(make_docs, odd_rows):
    got = fingerprints.anchors(make_docs(odd_rows)).collect()
    have = sorted((r.doc_id is None, r.doc_id or 0, [(a.pos, a.hash) for a in r.anchors]) for r in got)
    assert have == sorted((i is None, i or 0, plain_anchors(t)) for i, t, *_ in odd_rows)


def test_anchors_do_not_depend_on_context(make_docs):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = fingerprints.anchors(make_docs([(1, f"aa bb {passage}"), (2, f"{passage} cc dd")])).orderBy("doc_id").collect()
    first, second = [{a.hash: a.pos for a in r.anchors} for r in rows]
    common = first.keys() & second.keys()
    assert len(common) >= 15 and {first[h] - second[h] for h in common} == {2}


def test_with_next_edits_and_successors(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (9,)] + [(9, "alone now")]
    got = {r.doc_id: r for r in fingerprints.with_next(make_docs(rows)).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        assert got[i].edited == t[:len(t) - cut] + order[(k + 1) % len(order)][1][:cut] and got[i].n_chars == len(t)
    assert list(got[10].sketch) == list(got[11].sketch)


def test_with_next_repeated_null_and_no_rows(make_docs, odd_rows):
    assert fingerprints.with_next(make_docs(odd_rows)).count() == len(odd_rows)
    one = fingerprints.with_next(make_docs([(1, "abcdef")])).collect()
    assert one[0].edited == "abcdab"
    assert fingerprints.with_next(make_docs([])).count() == 0


def plain_sketch(text):
    found = {}
    for pos, h in plain_anchors(text):
        found.setdefault(h, pos)
    return sorted(found.items() if len(found) <= 64 else ((h, p) for h, p in found.items() if h % 4 == 0))


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    whole = [not x or any(h % 4 for h, _ in x) for x in (a, b)]
    if whole[0] != whole[1]:
        a, b = ([m for m in x if m[0] % 4 == 0] if w else x for x, w in ((a, whole[0]), (b, whole[1])))
    at = dict(b)
    distances = [at[h] - p for h, p in a if h in at]
    many = collections.Counter(distances)
    kept = len(distances) if len(distances) < 4 else sum(n for n in many.values() if n > 1)
    return kept / (len(a) + len(b) - kept) if len(a) + len(b) else 0.0


def texts_and_edits():
    rnd = random.Random(12)
    passage = " ".join(f"shared{k}" for k in range(200))
    long = [" ".join(f"{n}w{rnd.randrange(10**9)}" for _ in range(10_000)) for n in "abcd"]
    japanese = "".join(chr(rnd.randrange(0x3041, 0x3090) if rnd.random() < 0.6 else rnd.randrange(0x4E00, 0x5000)) for _ in range(3000))
    plain = " ".join(f"word{rnd.randrange(400)}" for _ in range(300))
    inserted = plain.split()
    inserted[100:100] = ["put", "in"]
    return {"passage": (f"{long[0]} {passage} {long[1]}", f"{long[2]} {passage} {long[3]}"),
            "japanese": (japanese, japanese[:2000] + "x" * 1000), "three": ("three words only", "three words o" + "zzz"),
            "insert": (plain, " ".join(inserted)), "same": (plain, plain), "apart": (plain, long[0][:3000]), "none": ("", " "),
            "spaceless": ("abcdefghij" * 300 + "k" * 9, "abcdefghij" * 300 + "m" * 9)}


def test_fingerprints_and_likeness_against_plain_versions(spark):
    cases = texts_and_edits()
    rows = [(k, *v) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "name string, x string, y string")
    df = fingerprints.sketches(fingerprints.sketches(df, "x", "a"), "y", "b")
    got = {r.name: r for r in df.select("name", "a", "b", fingerprints.likeness("a", "b").alias("near"),
                                        fingerprints.fingerprint("a").alias("print")).collect()}
    for name, (x, y) in cases.items():
        a, b = plain_sketch(x), plain_sketch(y)
        assert [tuple(m) for m in got[name].a] == a and [tuple(m) for m in got[name].b] == b, name
        assert got[name].near == pytest.approx(plain_likeness(a, b)), name
        assert got[name].print == ",".join(f"{h % (1 << 64):016x}.{p:x}" for h, p in a)
    assert got["passage"].near > 0 and got["japanese"].near > 0.4 and got["three"].near > 0.2
    assert got["same"].near == 1 and got["apart"].near == 0 and got["insert"].near > 0.85 and got["none"].near == 1


def test_likeness(make_docs, spark):
    rows = [([(1, 0), (2, 1), (3, 2)], [(1, 0), (2, 1), (3, 2)], 1.0), ([], [], 1.0), ([], [(1, 0)], 0.0),
            ([(1, 0), (2, 1)], [(3, 0), (5, 1)], 0.0), ([(1, 0), (2, 1), (3, 2)], [(2, 5), (3, 9), (5, 1)], 0.5),
            ([(k, k) for k in range(1, 7)], [(1, 8), (2, 9), (3, 30), (5, 12), (6, 41), (7, 3)], 3 / 9)]
    df = spark.createDataFrame(rows, f"a {fingerprints.MARKS}, b {fingerprints.MARKS}, want double")
    assert all(r.got == r.want for r in df.withColumn("got", fingerprints.likeness("a", "b")).collect())


def plain_prints(text):
    found = {}
    for pos, h in plain_anchors(text):
        found.setdefault(h, pos)
    return sorted(found.items())


def plain_near(a, b):
    if not a and not b:
        return 1.0
    at = dict(b)
    distances = [at[h] - p for h, p in a if h in at]
    many = collections.Counter(distances)
    kept = len(distances) if len(distances) < 4 else sum(n for n in many.values() if n > 1)
    return kept / (len(a) + len(b) - kept)


def test_fingerprints_hold_every_anchor_whatever_the_length(spark, make_docs, odd_rows, tmp_path):
    """Texts from below to far above 64 anchors, among them one anchor that a sample would have taken, too."""
    single = next(t for k in range(100) if plain_anchors(t := f"a{k} b c")[0][1] % 4 == 0 and len(plain_anchors(t)) >= 1)
    rows = [(k, " ".join(f"w{(k * j) % 977}" for j in range(30 * k))) for k in range(1, 20)] + [(30, single), (31, None), (32, "x y")]
    make_docs(rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    from riskbands.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 3
        own, edited, following = (plain_prints(x) for x in (t, t[:len(t) - cut] + after[:cut], after))
        assert got[i].fingerprint == ",".join(f"{h % (1 << 64):016x}.{p:x}" for h, p in own), i
        assert got[i].edited_fingerprint == ",".join(f"{h % (1 << 64):016x}.{p:x}" for h, p in edited), i
        assert got[i].near_edited == pytest.approx(plain_near(own, edited)), i
        assert got[i].near_next == pytest.approx(plain_near(own, following)), i


def test_with_next_over_many_blocks(spark, make_docs, monkeypatch):
    """Blocks of three documents, ids and rows repeated, null ids, across blocks and ranges."""
    monkeypatch.setattr(fingerprints, "BLOCK", 3)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(-60, 60)]), f"text {rnd.randrange(40)} " + "abc" * rnd.randrange(4)) for _ in range(300)]
    rows += [rows[0]] * 7
    df = make_docs(rows).select("doc_id", "text").repartition(5)
    hashes = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as h").collect()}
    order = sorted(hashes, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x]))
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    want = collections.Counter()
    for i, t in rows:
        cut = len(t) // 3
        want[i, t[:len(t) - cut] + after[i, t][1][:cut], len(t)] += 1
    assert collections.Counter((r.doc_id, r.edited, r.n_chars) for r in fingerprints.with_next(df).collect()) == want
