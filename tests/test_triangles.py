"""Linear regridding against a triangulation by brute force."""

from itertools import combinations

import numpy as np
import pytest

from cellclock.grid import Grid
from cellclock.operators.triangles import _hull, around, linear_regrid

GRID = Grid(0.0, 0.0, 1.0, 1.0, 14, 14)


def brute(points, centres):
    """Value at each centre from the triangle, of all triples, with an empty circumcircle."""
    p = np.array([(-lat, lon) for _, lon, lat, _ in points])
    v = np.array([x[3] for x in points])
    i, j, k = np.array(list(combinations(range(len(p)), 3))).T
    a, u, w = p[i], p[j] - p[i], p[k] - p[i]
    d = 2 * (u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0])
    ok = np.abs(d) > 1e-12
    i, j, k, a, u, w, d = i[ok], j[ok], k[ok], a[ok], u[ok], w[ok], d[ok]
    uu, ww = (u * u).sum(1), (w * w).sum(1)
    off = np.stack([w[:, 1] * uu - u[:, 1] * ww, u[:, 0] * ww - w[:, 0] * uu], 1) / d[:, None]
    r2 = (off * off).sum(1)
    empty = np.ones(len(i), bool)
    for q in p:
        empty &= ((a + off - q) ** 2).sum(1) >= r2 * (1 - 1e-9)
    i, j, k, a, u, w, d = i[empty], j[empty], k[empty], a[empty], u[empty], w[empty], d[empty] / 2
    out = []
    for c in centres:
        e = np.asarray(c) - a
        w2 = (e[:, 0] * w[:, 1] - e[:, 1] * w[:, 0]) / d
        w3 = (u[:, 0] * e[:, 1] - u[:, 1] * e[:, 0]) / d
        least = np.minimum(np.minimum(w2, w3), 1 - w2 - w3)
        t = int(np.argmax(least))
        out.append(None if least[t] < -1e-12 else v[i[t]] + w2[t] * (v[j[t]] - v[i[t]]) + w3[t] * (v[k[t]] - v[i[t]]))
    return out


def compared(spark, points, fill=None):
    df = spark.createDataFrame(points, "id int, lon double, lat double, value double")
    got = {(r["row"], r["col"]): r["value"] for r in linear_regrid(df, GRID, fill).collect()}
    assert len(got) == GRID.height * GRID.width
    return got


@pytest.mark.parametrize("kind", ["spread", "crowded", "few"])
def test_linear_is_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "spread":
        places = rng.uniform(-1, 13, (90, 2))
    elif kind == "crowded":  # most points in one cell, long triangles elsewhere
        places = np.concatenate([rng.normal(4.4, 0.02, (60, 2)), rng.uniform(0, 14, (15, 2)), [[40.0, 5.0], [6.0, -30.0]]])
    else:
        places = np.array([[1.2, 1.3], [9.7, 2.1], [4.4, 12.6], [5.1, 5.2]])
    points = [(i, float(x), float(-y), float(rng.uniform(0, 100))) for i, (y, x) in enumerate(places)]
    got = compared(spark, points)
    centres = [(r + 0.5, c + 0.5) for r in range(14) for c in range(14)]
    inside = 0
    for (y, x), want in zip(centres, brute(points, centres)):
        have = got[int(y - 0.5), int(x - 0.5)]
        assert (have is None) == (want is None), (y, x)
        if want is not None:
            inside += 1
            assert abs(have - want) < 1e-9 * max(1, abs(want)), (y, x)
    assert inside > 20


def test_a_plane_stays_a_plane(spark):
    """Regular points lie on common circles; a linear field is the same in every triangulation."""
    points = [(20 * r + c, float(c), float(-r), 3.0 * r - 2.0 * c + 1) for r in range(3, 12) for c in range(2, 11)]
    got = compared(spark, points, -9999.0)
    for (r, c), v in got.items():
        within = 3 <= r + 0.5 <= 11 and 2 <= c + 0.5 <= 10
        assert abs(v - (3.0 * (r + 0.5) - 2.0 * (c + 0.5) + 1 if within else -9999.0)) < 1e-9


def test_degenerate_points(spark):
    assert set(compared(spark, []).values()) == {None}
    assert set(compared(spark, [(1, 2.0, -2.0, 1.0), (2, 3.0, -3.0, 1.0)]).values()) == {None}
    assert set(compared(spark, [(i, float(i), float(-i), 1.0) for i in range(9)]).values()) == {None}
    twice = [(5, 1.0, -1.0, 7.0), (4, 1.0, -1.0, 3.0), (6, 12.0, -1.0, 3.0), (7, 1.0, -12.0, 3.0), (8, None, 1.0, 1.0), (9, 5.0, -5.0, None), (10, 5.0, -5.0, float("nan"))]
    assert {round(v, 9) for v in compared(spark, twice).values() if v is not None} == {3.0}


def test_walk_and_hull():
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 1, (200, 2))
    corners = _hull(points)
    steps = [(corners[i - 1] - corners[i - 2], corners[i] - corners[i - 1]) for i in range(len(corners))]
    turns = [a[0] * b[1] - a[1] * b[0] for a, b in steps]
    assert all(t > 0 for t in turns)
    triangle, (y, x, r2) = around([(-9, -9), (30, -9), (-9, 30)], 0.5, 0.5, points, (0.3, 0.7))
    assert (((points - (y, x)) ** 2).sum(1) > r2 * (1 - 1e-9)).all()
