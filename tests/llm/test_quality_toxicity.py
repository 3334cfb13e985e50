import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.common import held_out, platt, within_bytes
from tablewright.llm.quality import FEATURES, _dual_descent, fit_quality, fit_rows, score_quality, text_features
from tablewright.llm.toxicity import Keys, evidence, fit_linear, fit_toxicity, label_model, scale, score_toxicity, voter_rates
from tablewright.llm.words import Lookup, WordHasher, grams


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score int")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [a + b for a in "ba ke li mo nu ra se ti".split() for b in "lo mi na pe ru sa".split()]
    rows, marks = [], []
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 80)))
        bad, rude = r.random() < 0.3, r.random() < 0.3
        if rude:
            parts = text.split()
            for _ in range(2):
                parts.insert(r.randrange(len(parts)), r.choice(["grobian", "grobianer", "flegel"]))
            text = " ".join(parts)
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split())
        rows.append((i, text))
        marks.append((i, int(not bad), int(rude), 0))
    return rows, marks


def test_quality_holds_on_unseen_rows(spark, make_docs, corpus, odd):
    rows, marks = corpus
    docs = make_docs(rows + odd + [(0, rows[0][1])])
    model = fit_quality(docs, labels(spark, marks + [(1, None, None, 0), (9999, 1, 0, 0), (None, 0, 1, 0), (2, 7, 7, 0)]))
    got = score_quality(docs, model).withColumn("held", held_out("doc_id")).collect()
    assert len(got) == len(rows) + len(odd) + 1
    truth = {m[0]: m[1] for m in marks}
    unseen = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(unseen) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    empty = {round(r["score"], 12) for r in got if r["doc_id"] in (901, 902)}
    assert len(empty) == 1 and got[0]["bucket"] == "b"


@pytest.mark.parametrize("marks, score", [([], 0.5), ([(1, 1, 1, 0), (3, 1, 1, 0)], 1.0), ([(1, 0, 0, 0)], 0.0)])
def test_one_class_or_none(spark, make_docs, marks, score):
    docs = make_docs([(1, "one"), (2, "two"), (3, "three")])
    for fit, use in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        got = use(docs, fit(docs, labels(spark, marks))).collect()
        assert len(got) == 3 and all(abs(r["score"] - score) < 1e-5 for r in got)
        assert use(docs.limit(0), fit(docs.limit(0), labels(spark, marks))).count() == 0


def test_features_of_long_texts_are_those_of_their_parts():
    text = b"abc DEF 12|" * 200_000
    ids = text_features(text)
    short = text_features(text[: 11 * 50])
    assert set(short.tolist()) <= set(ids.tolist()) and ids.max() < FEATURES
    assert len(text_features(b"")) == 0
    assert text_features(b"the " * 50)[-1] >= FEATURES - 8


def test_hinge_model_separates():
    r = np.random.default_rng(0)
    rows, y = [], []
    for i in range(120):
        label = i % 2
        rows.append(np.unique(np.append(r.integers(0, 50, 10), 100 + label)).astype(np.int32))
        y.append(label)
    model = fit_rows(rows, np.array(y))
    margins = np.array([model.margin(x) for x in rows])
    assert ((margins > model.margin(np.zeros(0, np.int32)) - 10) & ((margins > 0) == (np.array(y) == 1))).mean() > 0.98


def test_dual_descent_equals_projected_gradient():
    """The same margins as a plain dense program on the same dual: gradient steps, cut to the box."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(30) < 0.3).astype(np.int32) for _ in range(40)] + [np.zeros(0, np.int32)]
    y = np.array([int((ids < 15).sum() > (ids >= 15).sum()) for ids in rows])
    scale = np.zeros(FEATURES)
    scale[:30] = rng.normal(size=30)
    w, bias = _dual_descent(rows, y, scale, 1.0, 4000)
    x = np.zeros((len(rows), 31))
    for k, ids in enumerate(rows):
        x[k, ids] = scale[ids] / (np.linalg.norm(scale[ids]) or 1.0)
    x[:, 30] = 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    upper = len(y) / (2 * np.array([(y == k).sum() for k in y]))
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(len(rows))
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) * step, 0, upper)
    plain = x.T @ (alpha * sign)
    assert np.abs(x @ plain - (x[:, :30] @ w[:30] + bias)).max() < 0.02


def test_quality_fit_is_bounded_in_bytes(spark, make_docs, corpus):
    rows, marks = corpus
    docs = make_docs(rows + [(5, rows[5][1] * 400)])
    whole, none = fit_quality(docs, labels(spark, marks)), fit_quality(docs, labels(spark, marks), most_bytes=10)
    less = fit_quality(docs, labels(spark, marks), most_bytes=60_000)
    assert abs(none.score(b"any text") - 0.5) < 1e-9
    assert 0 < np.count_nonzero(less.weight) < np.count_nonzero(whole.weight)


def test_platt_is_monotone():
    a, b = platt(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]))
    assert a > 0 and abs(b) < 1


def test_toxicity_holds_on_unseen_rows(spark, make_docs, corpus, odd):
    rows, marks = corpus
    docs = make_docs(rows + odd)
    got = score_toxicity(docs, fit_toxicity(docs, labels(spark, marks))).withColumn("held", held_out("doc_id")).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {m[0]: m[2] for m in marks}
    unseen = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_label_model_finds_rates_and_discounts_copies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    rates = [(0.6, 0.05), (0.5, 0.1), (0.4, 0.02), (0.1, 0.5)]
    votes = np.array([np.where(y, r.random(4000) < a, r.random(4000) < b) for a, b in rates]).T
    post, one, zero = label_model(votes, np.where(votes[:, 0], 0.8, 0.2))
    assert np.mean((post > 0.5) == y) > 0.8
    assert one[1] > zero[1] and one[2] > zero[2] and one[3] < zero[3]
    # Copies of a poor voter do not outvote annotators of known accuracy.
    told = y ^ (r.random(4000) < 0.1)
    given = np.where(told, 1.0, -1.0) * np.log(9.0)
    copied = np.hstack([votes] + [votes[:, 1:2]] * 8)
    plain, _, _ = label_model(votes, told.astype(float), given)
    again, _, _ = label_model(copied, told.astype(float), given)
    assert np.mean((plain > 0.5) == y) > 0.9 and np.mean((again > 0.5) == y) > 0.88


def test_rates_and_evidence_equal_plain_sums():
    r = np.random.default_rng(2)
    votes, post, counts = (r.random((60, 4)) < 0.3).astype(float), r.random(60), r.random(60)
    rate1, rate0, weight = rates = voter_rates(votes, post, counts)
    for v in range(4):
        fires = [i for i in range(60) if votes[i, v]]
        half = 0.5 * len(fires) / 60
        assert rate1[v] == pytest.approx((sum(post[i] * counts[i] for i in fires) + half) / (sum(post * counts) + 0.5))
        assert rate0[v] == pytest.approx((sum((1 - post[i]) * counts[i] for i in fires) + half) / (sum((1 - post) * counts) + 0.5))
    got = evidence(votes, rates)
    for i in range(60):
        assert got[i] == pytest.approx(sum(weight[v] * np.log(rate1[v] / rate0[v]) for v in range(4) if votes[i, v]))
    # Equal voters share one weight.
    assert voter_rates(np.hstack([votes, votes[:, :1]]), post)[2][[0, 4]] == pytest.approx([0.5, 0.5], rel=0.2)


def test_voters_overrule_annotators_and_label_the_rest():
    r = np.random.default_rng(3)
    y = r.random(6000) < 0.3
    votes = np.array([np.where(y, r.random(6000) < 0.7, r.random(6000) < 0.03) for _ in range(8)]).T
    told = np.where(r.random(6000) < 0.1, ~y, y).astype(int)  # one in ten is wrong
    told[3000:] = -1
    first = voter_rates(votes[:3000].astype(float), told[:3000].astype(float))
    start = evidence(votes, first)
    a, b = scale(start[:3000], told[:3000])
    post, rate1, rate0 = label_model(votes, 1 / (1 + np.exp(-(a * start + b))), told=told)
    assert np.mean((post >= 0.5) == y) > 0.97 and np.mean((post[3000:] >= 0.5) == y[3000:]) > 0.97
    wrong = (told >= 0) & (told != y)
    assert np.mean((post >= 0.5)[wrong] == y[wrong]) > 0.9
    assert abs(rate1[-1] - 0.9) < 0.05 and abs(rate0[-1] - 0.1) < 0.05


def test_scale_fits_shares_and_never_changes_sides():
    r = np.random.default_rng(4)
    y = (r.random(2000) < 0.1).astype(int)
    x = np.where(y == 1, 300.0, -300.0) + 400 * r.normal(size=2000)
    a, b = scale(x, y)
    assert a > 0 and np.mean(1 / (1 + np.exp(-(a * x + b)))) == pytest.approx(y.mean(), abs=0.01)
    assert scale(-x, y)[0] == 0.0 and np.isfinite(scale(np.zeros(5), np.array([0, 1, 0, 0, 1]))).all()


def test_report_and_bounded_rows(spark, make_docs, corpus):
    rows, marks = corpus
    model = fit_toxicity(make_docs(rows), labels(spark, marks[:250]), unlabelled=60)
    report = model.report
    assert report["unlabelled"] == 60 and 150 < report["labelled"] < 250 and 0 <= report["distance"] < 0.5
    less = fit_toxicity(make_docs(rows), labels(spark, marks[:250]), unlabelled=60, most_bytes=800)
    assert less.report["labelled"] < report["labelled"]
    df = spark.range(100).selectExpr("id as doc_id", "string(repeat('x', 10)) as t")
    assert len(within_bytes(df, F.length("t"), 1000)) == 100 and len(within_bytes(df, F.length("t"), 255)) == 25 and within_bytes(df, F.length("t"), 5) == []


def test_linear_model_learns():
    rows = [np.array([0, 2]), np.array([1, 2])] * 50
    w, bias = fit_linear(rows, np.array([1.0, 0.0] * 50), 3)
    assert w[0] + w[2] + bias > 1 and w[1] + w[2] + bias < -1


def test_words_do_not_depend_on_their_place():
    hasher = WordHasher()
    a, b = hasher.words(b"one two,three"), hasher.words(b"  three -- one")
    assert a.hashes[0] == b.hashes[1] and a.hashes[2] == b.hashes[0] and len(set(a.hashes.tolist())) == 3
    assert a.starts.tolist() == [0, 4, 8] and a.sizes.tolist() == [3, 3, 5]
    long = hasher.words(b"alpha beta " * 400_000)
    assert len(long.hashes) == 800_000 and len(set(long.hashes.tolist())) == 2
    assert len(hasher.words(b"").hashes) == 0 and len(hasher.words(b"...").hashes) == 0
    assert len(grams(a.hashes, 2)) == 2 and len(grams(a.hashes, 4)) == 0
    table = Lookup(np.sort(a.hashes))
    at, place = table.find(b.hashes)
    assert at.tolist() == [0, 1] and (table.keys[place] == b.hashes[at]).all()
    assert len(Keys().of("")) == 0
