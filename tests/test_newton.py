"""Newton fits against a plain fit in numpy, Spark ML, and on awkward tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cellclock.operators.models import cross_val_scores, positive_probability, scaled_logistic, vectors
from cellclock.operators.newton import Fit, NewtonLogistic, fit_logistics, held_out_scores


def plain(x, y, c):
    """Gradient descent with a fixed bound of the curvature: slow, but of another kind."""
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(len(z)), z])
    ridge = np.diag([0.0] + [1 / c] * x.shape[1])
    bound = np.linalg.inv(z.T @ z / 4 + ridge)
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w = w + bound @ (z.T @ (y - 1 / (1 + np.exp(-z @ w))) - ridge @ w)
    return w


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 50, 0.01] + [0, 1000, 7]
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - (x[:, 1] - 1000) / 40)))).astype(int)
    rows = [(i, i % 4, int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double").repartition(5)


def test_against_plain(made):
    x, y, df = made
    fits = [Fit(("a", "b", "c")), Fit(("a", "c"), NewtonLogistic(0.05)), Fit(("b", "a"), NewtonLogistic(2.0), without=1)]
    found = fit_logistics(df, fits, "y", "fold")
    seen = np.arange(len(y)) % 4 != 1
    for fit, model, rows, cols in zip(fits, found, (slice(None), slice(None), seen), ([0, 1, 2], [0, 2], [1, 0])):
        want = plain(x[rows][:, cols], y[rows], fit.settings.c)
        assert np.allclose([model.intercept, *model.weights], want, atol=1e-6)
        assert model.converged and model.steps < 15
        assert np.allclose(model.std, x[rows][:, cols].std(axis=0, ddof=1))


def test_a_batch_is_its_fits(made):
    _, _, df = made
    fits = [Fit(("a",)), Fit(("a", "b"), without=0), Fit(("c", "b"), NewtonLogistic(0.01), 3)]
    together = fit_logistics(df, fits, "y", "fold")
    for fit, model in zip(fits, together):
        (alone,) = fit_logistics(df, [fit], "y", "fold")
        assert np.allclose([alone.intercept, *alone.weights], [model.intercept, *model.weights], atol=1e-8)


def test_same_optimum_as_the_library(made):
    _, _, df = made
    (ours,) = fit_logistics(df, [Fit(("a", "b"))], "y")
    model = scaled_logistic("y", c=1.0, n=600, iterations=500).fit(vectors(df, ["a", "b"]))
    theirs = {r["id"]: r["p"] for r in positive_probability(model.transform(vectors(df, ["a", "b"]))).collect()}
    for r in ours.predict(df).collect():
        assert r["p"] == pytest.approx(theirs[r["id"]], abs=1e-4)


def test_held_out_rows_are_those_of_the_fold(made):
    _, _, df = made
    fits = [Fit(("a",), without=k) for k in range(4)]
    out = held_out_scores(df, fits, fit_logistics(df, fits, "y", "fold"), [7] * 4, "y", "fold")
    assert {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()} == dict.fromkeys(range(4), 150)
    assert {r["option"] for r in out.select("option").distinct().collect()} == {7}


def test_jobs_do_not_grow_with_the_fits(spark, made):
    _, _, df = made
    tracker = spark.sparkContext.statusTracker()

    def jobs(options):
        spark.sparkContext.setJobGroup(f"fits-{len(options)}", "fits")
        cross_val_scores(df, options, "y", NewtonLogistic(), folds=4)
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(f"fits-{len(options)}"))

    one, four = jobs([["a"]]), jobs([["a"], ["b"], ["c"], ["a", "b"]])
    assert four <= one + 6  # a step or two more, not four times the jobs


def test_missing_values_and_constant_columns(spark):
    rows = [(1, 1.0, 5.0, 0.1), (0, -1.0, 5.0, 0.1), (1, 0.5, 5.0, 0.1), (0, 0.7, 5.0, 0.1), (1, None, 5.0, 0.1), (0, float("nan"), 5.0, 0.1)]
    rows += [(1, float("inf"), 5.0, 0.1), (None, 3.0, 5.0, 0.1)]
    df = spark.createDataFrame(rows, "y int, a double, `b c` double, d double")
    (model,) = fit_logistics(df, [Fit(("a", "b c", "d"))], "y")
    want = plain(np.array([[1.0], [-1.0], [0.5], [0.7]]), np.array([1, 0, 1, 0]), 1.0)
    assert np.allclose([model.intercept, model.weights[0]], want, atol=1e-6)
    assert model.weights[1:] == (0.0, 0.0) and model.slopes()["b c"] == 0.0
    assert model.predict(df).count() == 5  # the row without a label has a score as well


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, a double")
    (model,) = fit_logistics(df, [Fit(("a",))], "y")
    assert model.intercept == math.inf and {r["p"] for r in model.predict(df).collect()} == {1.0}
    (model,) = fit_logistics(df.where("y = 0"), [Fit(("a",))], "y")
    assert model.intercept is None and [r["p"] for r in model.predict(df).collect()] == [None, None]
    assert fit_logistics(df, [], "y") == []


def test_separable_rows_without_much_penalty(spark):
    df = spark.createDataFrame([(int(i >= 10), float(i)) for i in range(20)], "y int, a double")
    (model,) = fit_logistics(df, [Fit(("a",), NewtonLogistic(1e4))], "y")
    assert model.converged
    assert all((r["p"] > 0.5) == (r["y"] == 1) for r in model.predict(df).collect())
