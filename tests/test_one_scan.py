"""Profiles read their input once over all their jobs, and match numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cellclock.operators.histograms import kde_bounds, trimmed_density
from cellclock.operators.profile import band_stats, box_stats, maxabs_stats

RNG = np.random.default_rng(3)
VALUES = {"a": RNG.normal(size=300).round(2), "b": RNG.exponential(size=200).round(1)}
# Repeated rows, a group of one value, a group with nothing but missing values.
VALUES["c"] = np.full(50, 1e9 + 0.5)
ROWS = [(g, float(v)) for g, vs in VALUES.items() for v in vs] + [("a", None), ("a", math.nan), ("d", None)]


@pytest.fixture
def counted(spark):
    """The table, and the number of rows that all jobs together have read of it."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(ROWS, "band string, value double").repartition(3)
    return df.mapInArrow(watch, df.schema), seen


@pytest.mark.parametrize("profile", [band_stats, maxabs_stats])
def test_band_stats(counted, profile):
    df, seen = counted
    found = {r["band"]: r for r in profile(df).collect()}
    assert seen.value == len(ROWS)
    assert set(found) == set(VALUES)
    for g, vs in VALUES.items():
        r = found[g]
        assert (r["count"], r["min"], r["max"], r["max_abs"]) == (len(vs), vs.min(), vs.max(), np.abs(vs).max())
        assert r["mean"] == pytest.approx(vs.mean(), abs=1e-9, rel=1e-15)
        for name, p in (("p2", 2), ("median", 50), ("p98", 98)):
            assert r[name] == pytest.approx(np.percentile(vs, p), abs=1e-9)


def test_box_stats(counted):
    df, seen = counted
    found = {r["band"]: r for r in box_stats(df, "value", ["band"]).collect()}
    assert seen.value == len(ROWS)
    for g, vs in VALUES.items():
        q1, q3 = np.percentile(vs, [25, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = vs[(vs >= low) & (vs <= high)]
        assert found[g]["outliers"] == len(vs) - len(inside)
        assert (found[g]["whisker_low"], found[g]["whisker_high"]) == (inside.min(), inside.max())


def test_trimmed_density(counted):
    df, seen = counted
    rows = trimmed_density(df, "value", 10, ["band"]).collect()
    assert seen.value == len(ROWS)
    for g in ("a", "b"):
        vs = VALUES[g]
        lo, hi = np.percentile(vs, [0.5, 99.5])
        inside = vs[(vs >= lo) & (vs <= hi)]
        mine = [r for r in rows if r["band"] == g]
        assert sum(r["count"] for r in mine) == len(inside)
        assert sum(r["density"] for r in mine) * (hi - lo) / 10 == pytest.approx(1)


def test_kde_bounds(counted):
    df, seen = counted
    found = {r["band"]: r for r in kde_bounds(df, "value", ["band"]).collect()}
    assert seen.value == len(ROWS)
    assert (found["c"]["x_left"], found["c"]["x_right"]) == (None, None)
    vs = VALUES["a"]
    lo, hi = np.percentile(vs, [0.5, 99.5])
    assert all(x is None or lo < x < hi for x in (found["a"]["x_left"], found["a"]["x_right"]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "band string, value double")
    assert band_stats(df).collect() == [] and box_stats(df, "value", ["band"]).collect() == []
    assert kde_bounds(df, "value", ["band"]).collect() == []
