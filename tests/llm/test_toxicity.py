import math
import re
import zlib

import numpy as np
import pytest

from cellclock.llm import toxicity

from .conftest import ODD, prose


@pytest.fixture(scope="module")
def corpus(make, spark):
    """Toxic texts mention women far more often than others do; insults make them toxic."""
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = prose(40 if i % 50 else 4000, i).split()
        if bad:
            words[7] = ("Vermin!", "scumbag", "vermins")[i % 9 // 3]
        if i % (3 if bad else 30) == 0 and i % 4:
            words[3] = "women"
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), "z"))
    return make(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), texts


def brute_score(model, text):
    """The score by its definition: weights of all distinct words and beginnings."""
    features = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        features |= {w} | {w[:n] + "-" for n in (4, 5, 6) if len(w) > n}
    return 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in sorted(features))))


def test_held_out_accuracy(corpus):
    docs, labels, texts = corpus
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert sorted(got) == list(range(600))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == (i % 3 == 0) for i, r in got.items() if r.held_out]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_scores_follow_the_model(corpus, make):
    docs, labels, texts = corpus
    data = toxicity.train(docs, labels)
    model = toxicity.ToxicityModel.loads(data)
    for frame, pairs in ((docs, texts), (make(ODD), ODD)):
        got = sorted((str(r.doc_id), round(r.score, 12)) for r in toxicity.score(frame, data).collect())
        assert got == sorted((str(i), round(brute_score(model, t), 12)) for i, t in pairs)


def test_equal_texts_have_equal_scores(corpus, make):
    _, labels, texts = corpus
    docs = make([(i, t) for i, t in texts] + [(1000 + i, t) for i, t in texts])
    data = toxicity.train(corpus[0], labels)
    a = {r.doc_id: r.score for r in toxicity.score(docs.repartition(5), data).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs.coalesce(1), data).collect()}
    assert a == b and all(a[i] == a[1000 + i] for i, _ in texts)


def test_neutral_mentions_stay_clean(corpus):
    docs, labels, _ = corpus
    plain = toxicity.ToxicityModel.loads(toxicity.train(docs, labels, pairing=0.0))
    fair = toxicity.ToxicityModel.loads(toxicity.train(docs, labels))
    neutral = [prose(12, 5000 + i) + " women " + prose(8, 6000 + i) for i in range(50)]
    swapped = [t.replace("women", "men") for t in neutral]
    gap = lambda m: np.mean([abs(m.score(a) - m.score(b)) for a, b in zip(neutral, swapped)])
    assert plain.weights.get("women", 0) > 0.1 > abs(fair.weights.get("women", 0))
    assert gap(fair) < 0.3 * gap(plain)
    assert np.mean([fair.score(t) for t in neutral]) < np.mean([plain.score(t) for t in neutral])
    assert fair.score("they are Vermin") > 0.5


def test_swaps():
    words = {"women", "muslim", "x"}
    got = toxicity.swapped(words)
    assert len(got) == toxicity.SWAPS and all("x" in w and not w & words - {"x"} and len(w) == 3 for w in got)
    assert toxicity.swapped({"x"}) == [] and toxicity.swapped(set()) == []
    assert toxicity.swapped({"she", "he"})[0] == {"she", "he"}


def test_fit_is_a_minimum():
    rng = np.random.default_rng(8)
    x = [sorted(rng.choice(30, 8, replace=False).tolist()) for _ in range(200)]
    y = np.array([float(0 in f or 1 in f) for f in x])
    y[:10] = 1 - y[:10]
    pairs = [([2], [3])] * 5 + [([4, 5], [])] * 3

    def loss(w, b):
        z = np.array([w[f].sum() for f in x]) + b
        gap = np.array([w[a].sum() - w[c].sum() for a, c in pairs])
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)) + 1e-3 * np.abs(w).sum() + 2.0 * np.mean(gap**2)

    w, b = toxicity.fit(x, y, pairs, 30, lasso=1e-3, pairing=2.0, steps=3000)
    least = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.standard_normal(30) * 10 ** rng.uniform(-4, -1), b + rng.standard_normal() * 0.01) > least - 1e-9
    assert w[0] > 1 and w[1] > 1 and abs(w[2] - w[3]) < 0.05


def test_odd_tables(corpus, make, empty, spark):
    docs, labels, _ = corpus
    odd = make(ODD)
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty, labels).collect() == []
    strange = spark.createDataFrame([(None, 1), (3, None), (3, 7), (4, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, strange).count() == 600
    same = toxicity.score(odd, toxicity.train(docs, labels))
    assert sorted(same.columns) == sorted(odd.columns)  # score is replaced
