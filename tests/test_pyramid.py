"""The tile pyramid: results against numpy, and how few pairs it makes in crowded places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellclock.grid import Grid
from cellclock.operators import nearest
from cellclock.operators.pyramid import nearest_pairs


def frame(spark, rows, weight=True):
    y, x = np.asarray(rows, float).T
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"_y": y, "_x": x}))
    return df.withColumn("_n", F.lit(1).cast("long")) if weight else df


@pytest.mark.parametrize("need", [1, 5])
def test_pairs_hold_all_nearest(spark, need):
    rng = np.random.default_rng(need)
    sources = np.unique(np.concatenate([rng.uniform(0, 40, (150, 2)), rng.normal(7.3, 0.01, (400, 2)), [[7.3, 7.3], [500.0, -300.0]]]), axis=0)
    targets = np.array([(r + 0.5, c + 0.5) for r in range(20) for c in range(20)])
    got = {}
    for r in nearest_pairs(frame(spark, targets, False), frame(spark, sources), need, leaf=8).collect():
        got.setdefault((r._ty, r._tx), set()).add((r._y, r._x))
    for t in targets:
        d2 = ((sources - t) ** 2).sum(1)
        wanted = sources[d2 <= np.sort(d2)[need - 1]]
        assert set(map(tuple, wanted)) <= got[tuple(t)]
    assert sum(map(len, got.values())) < 60 * len(targets)


def test_a_million_points_in_one_bin(spark):
    """Every cell of the map wants points of the same bin; few rows may come of them."""
    n, g = 1_000_000, Grid(0.0, 0.0, 1.0, 1.0, 40, 40)
    unit = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    points = spark.range(n).select("id", (12 + unit(1)).alias("lon"), (-7 - unit(2)).alias("lat"), F.col("id").cast("double").alias("value")).cache()
    centres = spark.range(1600).select((F.floor(F.col("id") / 40) + 0.5).alias("_y"), (F.pmod("id", F.lit(40)) + 0.5).alias("_x"))
    sources = points.select((-F.col("lat")).alias("_y"), F.col("lon").alias("_x"), F.lit(1).cast("long").alias("_n"))
    assert nearest_pairs(centres, sources).count() < 200 * 1600 < n  # a bounded number for each cell
    got = {(r["row"], r["col"]): r["value"] for r in nearest.nearest_regrid(points, g).collect()}
    rows = points.toPandas()
    lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
    for r, c in [(0, 0), (7, 12), (7, 13), (39, 39), (6, 12), (20, 3), (0, 12), (39, 0)]:
        d2 = (-lat - r - 0.5) ** 2 + (lon - c - 0.5) ** 2
        assert got[r, c] == rows["value"][int(np.argmin(d2))]
    points.unpersist()


def test_neighbours_of_crowded_and_lonely_cells(spark):
    rng = np.random.default_rng(9)
    cells = [(i, 50, 50) for i in range(3000)] + [(3000 + i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(48, 53, (400, 2)))]
    cells += [(9000, 900, -700), (9001, -5, 4), (9002, None, 3)]
    df = spark.createDataFrame(cells, "id int, row int, col int").withColumn("v", F.col("id").cast("double"))
    rows = nearest.nearest_neighbours(df, 6, ["v"]).collect()
    assert len(rows) == len(cells)
    known = [p for p in cells if p[1] is not None]
    for r in rows[:: len(rows) // 60] + [r for r in rows if r["id"] >= 9000]:
        if r["row"] is None:
            assert r["neighbours"] is None
            continue
        want = sorted(((p[1] - r["row"]) ** 2 + (p[2] - r["col"]) ** 2, p[0]) for p in known if p[0] != r["id"])[:6]
        assert [(m["d2"], m["key"]) for m in r["neighbours"]] == want
