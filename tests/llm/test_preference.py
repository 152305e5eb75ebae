import math
import os
import zlib

import numpy as np
import pytest

from riskbands.llm import preference, queries
from riskbands.llm.common import table

SF = "/root/testdata/sf0.1"


def test_measures():
    named = dict(zip(preference.MEASURES, preference.measures(b"The the the #x 12! ok. ok. ok.\nA\nA"), strict=True))
    assert named["symbols"] == 1 / 10 and named["digits"] == 2 / 25 and named["capitals"] == 3 / 25
    assert named["neighbours"] == 4 / 10 and named["same_words"] == 4 / 10 and named["same_lines"] == 1 / 3
    assert named["calls"] == 1 / 10 and named["one_letter"] == 2 / 10
    assert preference.measures(None) == preference.measures(b"") == [0.0] * len(preference.MEASURES)


def test_fit_reaches_the_optimum_of_the_pair_loss():
    """The weights have the least pairwise logistic loss: no small change of them lowers it."""
    rnd = np.random.default_rng(1)
    good, bad = rnd.normal(0.3, 0.2, (60, 3)).clip(0), rnd.normal(0.2, 0.2, (40, 3)).clip(0)
    model = preference.fit(good, bad, pairs=60)
    g, b = ((preference.bent(x) - model.mean) / model.spread for x in (good, bad))
    d = (g[:, None] - b[None]).reshape(-1, g.shape[1])

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + preference.RIDGE / 2 * w @ w

    least = loss(model.weights)
    for k in range(len(model.weights)):
        for step in (-1e-2, 1e-2):
            assert loss(model.weights + step * np.eye(len(model.weights))[k]) > least
    assert (g @ model.weights).mean() > (b @ model.weights).mean()


def test_more_bad_than_good_rows():
    rnd = np.random.default_rng(2)
    model = preference.fit(rnd.uniform(0, 1, (5, 4)) + 2, rnd.uniform(0, 1, (50, 4)))
    assert model.scores(np.full((1, 4), 2.5)) > model.scores(np.full((1, 4), 0.5))


def test_quantile_over_all_labelled_rows(spark):
    values = [(k, float(v)) for k, v in enumerate([-3, -2.5, -2, 1, 1.5, 2, 2.5, 3, 9, 9])]
    scores = spark.createDataFrame(values, "doc_id long, value double")
    known = spark.createDataFrame([(k, int(k > 2)) for k in range(9)], "__id long, __label int")
    assert preference.quantile_of(scores, known)[0] == (-2 + 1) / 2
    mixed = spark.createDataFrame([(k, k % 2) for k in range(9)], "__id long, __label int")
    below = sum(v < preference.quantile_of(scores, mixed)[0] for _, v in values[:9])
    assert below == 5


def label_rows(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def test_odd_rows_and_ties(spark, make_docs, odd_rows):
    junk = [(k, "buy buy buy buy now!!! $$$ ### " * (k % 5 + 2)) for k in range(1000, 1100)]
    fine = [(k, f"a plain line of text number {k} that says something else each time, more or less " * 2) for k in range(2000, 2100)]
    docs = make_docs([*odd_rows, *junk, *fine])
    labels = label_rows(spark, [*[(k, 0) for k, _ in junk], *[(k, 1) for k, _ in fine], (7, None), (8, 5), (None, 1),
                                (1000, 0), (99_999, 0)])
    got = preference.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        by_id.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert len(by_id[9]) == 1
    assert all(p == 0 for k, _ in junk for _, p in by_id[k]) and all(p == 1 for k, _ in fine for _, p in by_id[k])


@pytest.mark.parametrize("rows, base", [([], 0.5), ([(15, 1), (16, 1), (17, 1), (18, 1)], 1.0), ([(15, 0), (16, 0), (17, 0), (18, 0)], 0.0)])
def test_one_class_or_none(spark, make_docs, odd_rows, rows, base):
    got = preference.quality_scores(make_docs(odd_rows), label_rows(spark, rows)).collect()
    assert {r.score for r in got} == {base} and len(got) == len(odd_rows)


def test_empty_table(spark, make_docs):
    assert preference.quality_scores(make_docs([]), label_rows(spark, [(1, 0), (2, 1)])).collect() == []


def test_held_out_labels_are_never_read(spark, make_docs, odd_rows):
    rows = [(k, ("word " * 30 if k % 2 else f"many different words {k} stand here in a row")) for k in range(300)]
    docs = make_docs(rows)
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = [(k, 1 - k % 2) for k, _ in rows]
    turned = [(k, 1 - q if k in out else q) for k, q in labels]
    one, two = (sorted(map(tuple, preference.quality_scores(docs, label_rows(spark, x)).collect())) for x in (labels, turned))
    assert one == two


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_held_out_accuracy(spark):
    got = queries.op11_preference(spark, SF)
    known = table(spark, SF, "labels").select("doc_id", "quality").filter("quality IS NOT NULL")
    rows = got.filter("held_out").join(known, "doc_id").collect()
    assert len(rows) > 500
    right = {q: [r.predicted == q for r in rows if r.quality == q] for q in (0, 1)}
    assert all(sum(x) / len(x) >= 0.97 for x in right.values())
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.99
    assert all(not math.isnan(r.score) for r in rows)
