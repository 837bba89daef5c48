"""Staged losses of boosted trees against the library's own, and the stop by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellclock.operators import models


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (900, 3))
    y = (x[:, 0] + 1.5 * rng.normal(0, 1, 900) > 0).astype(int)  # so noisy that later rounds only learn noise
    rows = [(i, int(i % 3), *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, horizon int, a double, b double, c double, label int")
    train = models.vectors(df.where("id < 300").withColumn("label", F.col("label").cast("double")), ["a", "b", "c"])
    return models.gbt("label", iterations=14, depth=4).fit(train), df.where("id >= 300")


def test_staged_losses_are_those_of_the_library(fitted):
    model, held = fitted
    got = models.staged_losses(model, held, ["a", "b", "c"]).collect()
    assert len(got) == 3 * 14
    for h in range(3):
        own = models.vectors(held.where(F.col("horizon") == h).withColumn("label", F.col("label").cast("double")), ["a", "b", "c"])
        want = model.evaluateEachIteration(own)  # twice the log loss
        have = [r.loss for r in sorted(got, key=lambda r: r.round) if r.horizon == h]
        assert have == pytest.approx([v / 2 for v in want], rel=1e-9)
        last = next(r for r in got if r.horizon == h and r.round == 14)
        told = model.transform(own).select("label", "prediction").collect()
        tp = sum(r.label == r.prediction == 1 for r in told)
        assert last.n == len(told)
        assert last.precision_1 == pytest.approx(tp / sum(r.prediction for r in told))
        assert last.recall_1 == pytest.approx(tp / sum(r.label for r in told))


def test_training_stops_before_the_last_round(fitted):
    losses = models.staged_losses(*fitted, ["a", "b", "c"])
    report = models.early_stop_report(losses, patience=3).collect()
    curve = [r.loss for r in sorted(losses.where("horizon = 2").collect(), key=lambda r: r.round)]
    best, stop = 0, len(curve)
    for i, v in enumerate(curve):
        if v < curve[best]:
            best = i
        if i - best >= 3:
            stop = i + 1
            break
    assert stop < 14
    assert [(r.stop_round, r.best_round, r.best_score) for r in report] == [(stop, best + 1, curve[best])] * 3
    assert sorted(r.horizon for r in report) == [0, 1, 2]


def test_report_by_hand(spark):
    rows = [(h, r, 1, loss, 0.0, 0.0, 0.0) for h, curve in ((0, [5, 4, 3, 2, 1]), (1, [3, 2, 2.5, 2.4, 1])) for r, loss in enumerate(map(float, curve), 1)]
    losses = spark.createDataFrame(rows, "horizon int, round int, n long, loss double, precision_1 double, recall_1 double, f1_1 double")
    assert {(r.stop_round, r.best_round, r.best_score) for r in models.early_stop_report(losses, 2).collect()} == {(4, 2, 2.0)}
    assert {(r.stop_round, r.best_round, r.best_score) for r in models.early_stop_report(losses, 2, decides=0).collect()} == {(5, 5, 1.0)}
    assert {(r.stop_round, r.best_round) for r in models.early_stop_report(losses, 3).collect()} == {(5, 5)}
    assert models.early_stop_report(losses.limit(0), 2).collect() == []


@pytest.mark.parametrize("name", ["gbt_early_stop", "gbt_classifier"])
def test_training_partitions_are_bounded(spark, monkeypatch, name):
    """A fit gets more partitions, not larger ones, when there are more rows."""
    from conftest import SF_DIR
    from pyspark.ml.classification import GBTClassifier

    from cellclock.plans.registry import load

    class Seen(Exception):
        pass

    def fit(self, data):
        raise Seen([r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()])

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    monkeypatch.setattr(models, "PART_ROWS", 100, raising=False)
    with pytest.raises(Seen) as seen:
        load()[0][name](spark, SF_DIR)
    sizes = seen.value.args[0]
    assert sum(sizes) > 500 and max(sizes) < 60
