"""Linear interpolation of irregular points on a grid, by the triangle around each cell.

The triangle of the Delaunay triangulation that holds a cell's centre is found without the
rest of the triangulation. Any triangle of points around the centre is a start; a point
inside its circumcircle replaces one of the corners, so that the new triangle still holds
the centre and lies lower on the lifted paraboloid; without such a point the triangle is
the Delaunay one. Points that can be inside are first sought among the centre's nearest,
and then by asking for the points nearest to the circumcentre, which is the same pyramid
search for all cells at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellclock.grid import Grid
from cellclock.names import q
from cellclock.operators.nearest import _positions
from cellclock.operators.pyramid import nearest_pairs
from cellclock.session import cut

NEAR = 24  # points around a centre that are looked at first
AROUND = 8  # points around a circumcentre that are asked for in a round
ROUNDS = 60
INSIDE = 1e-11  # share of the squared radius that a point must be inside by
BORDER = 1e-12  # weight below which a place is on the border of a triangle
ASIDE = 1e-6
FLAT = 1e18  # squared radius of a circle whose part within the hull is thinner than rounding


def _hull(points):
    """Corners of the convex hull of an (n, 2) array, counter-clockwise."""
    import numpy as np

    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points.tolist()) + half(points[::-1].tolist()))


def hull(places: DataFrame, fan: int = 32) -> DataFrame:
    """(_y, _x) of the corners of the convex hull of all positions. Every task leaves the
    corners of its own points, and ``fan`` tasks' corners are merged at a time, so what
    meets in one task are corners and not points."""

    def corners(batches):
        import numpy as np
        import pyarrow as pa

        held = np.empty((0, 2))
        for batch in batches:
            if batch.num_rows:
                held = _hull(np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(2)], 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(2)], names=["_y", "_x"])

    out, n = places.select("_y", "_x").mapInArrow(corners, "_y double, _x double"), places.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        out = out.repartition(n).mapInArrow(corners, "_y double, _x double")
    return out


def around(triangle, y: float, x: float, points, anchor):
    """The Delaunay triangle of ``points`` and the corners of ``triangle`` that holds
    (y, x), given a triangle that does; and its circumcircle (y, x, squared radius).

    On an edge, the triangle on the side of ``anchor``, a place inside the hull, is taken;
    so every step goes down at a place near the centre, and the walk ends."""
    import numpy as np

    # Coordinates from the centre on keep the digits that decide; corners are named by
    # their number, so that they come back as they were given.
    given = np.concatenate([np.asarray(triangle, float), np.asarray(points, float).reshape(-1, 2)])
    local = given - (y, x)
    heights = (local * local).sum(1)
    at, aside = [0, 1, 2], (np.asarray(anchor) - (y, x)) * ASIDE
    for _ in range(10_000):
        level, slope = _plane(local[at])
        r2 = level + slope @ slope / 4
        depth = level + local @ slope - heights  # squared radius less squared distance
        depth[at] = 0
        deepest = int(np.argmax(depth))
        if not np.isfinite(r2) or depth[deepest] <= INSIDE * min(r2, 1 + heights[deepest]):
            return given[at], (slope[0] / 2 + y, slope[1] / 2 + x, r2)
        # of the three triangles with the new corner, the one that holds the centre
        at = max(([at[i], at[j], deepest] for i, j in ((0, 1), (1, 2), (2, 0))), key=lambda t: _held(local[t], aside))
    raise ArithmeticError("the walk to the Delaunay triangle does not end")


def _plane(corners):
    """(height at the origin, slope) of the plane through the corners lifted to the
    paraboloid of squared distances; points above it lie outside the circumcircle."""
    import numpy as np

    a, b, c = corners
    u, v = b - a, c - a
    d = u[0] * v[1] - u[1] * v[0]
    if d == 0:
        return np.inf, np.zeros(2)
    hu, hv = b @ b - a @ a, c @ c - a @ a
    slope = np.array([v[1] * hu - u[1] * hv, u[0] * hv - v[0] * hu]) / d
    return a @ a - slope @ a, slope


def weights(corners, y: float = 0.0, x: float = 0.0):
    """Barycentric weights of a position in a triangle; None where it is flat."""
    a, b, c = corners
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if d == 0:
        return None
    wb = ((y - a[0]) * (c[1] - a[1]) - (x - a[1]) * (c[0] - a[0])) / d
    wc = ((b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0])) / d
    return 1 - wb - wc, wb, wc


def _held(corners, aside) -> tuple:
    """How well a triangle holds the origin: inside, on its border or not at all; then how
    well it holds a place a little aside."""
    w = weights(corners)
    if w is None:
        return -2, 0.0
    least = min(w)
    return (1 if least > BORDER else 0 if least >= -BORDER else -1), min(weights(corners, *aside))


def _anchor(corners):
    """A place inside a convex outline that lies on no line through points of a lattice."""
    import numpy as np

    share = 0.5 + np.modf(np.arange(1, len(corners) + 1) * 0.6180339887498949)[0]
    return (corners * share[:, None]).sum(0) / share.sum()


def _start(corners, y: float, x: float, anchor):
    """A triangle of hull corners that holds (y, x), or None outside the hull."""
    import numpy as np

    a, aside = corners[0], (np.asarray(anchor) - (y, x)) * ASIDE
    # the fan from one corner: the only parts that can hold it are found by bisection
    low, high = 1, len(corners) - 1
    side = lambda b: (b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0])
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if side(corners[mid]) >= 0 else (low, mid)
    fan = [np.stack([a, corners[i], corners[i + 1]]) for i in (low - 1, low, low + 1) if 1 <= i < len(corners) - 1]
    held = [_held(t - (y, x), aside) for t in fan]
    best = max(held)
    return fan[held.index(best)] if best[0] >= 0 else None


STATE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("_ty", "_tx", "y1", "x1", "y2", "x2", "y3", "x3", "cy", "cx", "r2")]
    + [T.StructField("sure", T.BooleanType())]
)


def linear_regrid(points: DataFrame, grid: Grid, fill: float | None = -9999.0, tie: str = "id") -> DataFrame:
    """Irregular (lon, lat, value) points to the grid by linear interpolation in the
    Delaunay triangle that holds a cell's centre; ``fill`` outside the convex hull.

    Points at one place count once, with the value of the lowest ``tie``; points without
    a place or a value are left out. Where more than three points lie on one circle, one of their
    triangulations is used. Fewer than three points, or points on one line, fill nothing.

    The corners of the hull, a few even for very many points, go to all tasks. A cell's
    first triangle comes from its nearest points; cells whose circumcircle may hold others
    ask for the points nearest to its centre until none is inside.
    """
    import numpy as np

    spark = points.sparkSession
    y = (F.lit(grid.lat0) - F.col("lat")) / F.lit(grid.dy)
    x = (F.col("lon") - F.lit(grid.lon0)) / F.lit(grid.dx)
    known = points.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    places = cut(_positions(known, y, x, F.struct(q(tie).alias("tie"), F.col("value").cast("double").alias("v"))))
    cells = spark.range(grid.height * grid.width).select(
        F.floor(F.col("id") / grid.width).cast("int").alias("row"),
        F.pmod("id", F.lit(grid.width)).cast("int").alias("col"),
    )
    corners = [(r["_y"], r["_x"]) for r in hull(places).collect()]  # corners only
    empty = cells.withColumn("value", F.lit(fill).cast("double"))
    if len(corners) < 3:
        return empty
    shared = spark.sparkContext.broadcast((corners, _anchor(np.array(corners))))
    centres = cells.select((F.col("row") + 0.5).alias("_y"), (F.col("col") + 0.5).alias("_x"))
    near = nearest_pairs(centres, places, NEAR)
    listed = near.groupBy("_ty", "_tx").agg(F.array_sort(F.collect_list(F.struct("_y", "_x"))).alias("_near"))  # few for each cell

    def first(batches):
        import numpy as np

        outline, anchor = np.array(shared.value[0]), shared.value[1]
        for batch in batches:
            rows = []
            for ty, tx, have in zip(*(batch.column(i).to_pylist() for i in range(3))):
                triangle = _start(outline, ty, tx, anchor)
                if triangle is not None:
                    rows.append(_solved(ty, tx, triangle, [(p["_y"], p["_x"]) for p in have], anchor))
            yield _batch(rows)

    state = cut(listed.mapInArrow(first, STATE))
    done, still = [], state
    for _ in range(ROUNDS):
        # A circle inside the disk of the points already seen is empty; others are asked about.
        asked = still.where("NOT sure").select(F.col("cy").alias("_y"), F.col("cx").alias("_x")).distinct()
        done.append(still.where("sure"))
        still = still.where("NOT sure")
        if still.isEmpty():
            break
        seen = nearest_pairs(cut(asked), places, AROUND).groupBy(F.col("_ty").alias("cy"), F.col("_tx").alias("cx"))
        seen = seen.agg(F.array_sort(F.collect_list(F.struct("_y", "_x"))).alias("_near"))
        again = still.join(seen, ["cy", "cx"]).select(*[c for c in STATE.names if c not in ("r2", "sure", "cy", "cx")], "_near")

        def more(batches):
            for batch in batches:
                rows = []
                for ty, tx, y1, x1, y2, x2, y3, x3, have in zip(*(batch.column(i).to_pylist() for i in range(9))):
                    rows.append(_solved(ty, tx, [(y1, x1), (y2, x2), (y3, x3)], [(p["_y"], p["_x"]) for p in have], shared.value[1], True))
                yield _batch(rows)

        still = cut(again.mapInArrow(more, STATE))
    else:
        raise ArithmeticError("triangles are still open")
    final = reduce(DataFrame.unionByName, done)
    corner = F.explode(F.array(*[F.struct(F.col(f"y{i}").alias("_y"), F.col(f"x{i}").alias("_x"), F.lit(i).alias("i")) for i in (1, 2, 3)]))
    valued = final.select("_ty", "_tx", corner.alias("_c")).select("_ty", "_tx", "_c.*").join(places.select("_y", "_x", "_p.v"), ["_y", "_x"])
    wide = valued.groupBy("_ty", "_tx").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{n}{i}") for i in (1, 2, 3) for c, n in (("_y", "y"), ("_x", "x"), ("v", "v"))])
    dy, dx = (lambda i, j: F.col(f"y{i}") - F.col(f"y{j}")), (lambda i, j: F.col(f"x{i}") - F.col(f"x{j}"))
    py, px = F.col("_ty") - F.col("y1"), F.col("_tx") - F.col("x1")
    det = dy(2, 1) * dx(3, 1) - dx(2, 1) * dy(3, 1)
    w2, w3 = (py * dx(3, 1) - px * dy(3, 1)) / det, (dy(2, 1) * px - dx(2, 1) * py) / det
    value = F.col("v1") + w2 * (F.col("v2") - F.col("v1")) + w3 * (F.col("v3") - F.col("v1"))
    named = wide.select((F.col("_ty") - 0.5).cast("int").alias("row"), (F.col("_tx") - 0.5).cast("int").alias("col"), value.alias("_v"))
    return cells.join(named, ["row", "col"], "left").select("row", "col", F.coalesce("_v", F.lit(fill).cast("double")).alias("value"))


def _solved(ty: float, tx: float, triangle, have: list, anchor, of_circle: bool = False) -> tuple:
    """A row of the state. ``have`` are the nearest points of the cell or, if
    ``of_circle``, of the triangle's circumcentre."""
    corners, (cy, cx, r2) = around(triangle, ty, tx, have, anchor)
    if of_circle:  # none of the points nearest to the centre is inside, so no point is
        sure = sorted(map(tuple, corners.tolist())) == sorted((float(a), float(b)) for a, b in triangle)
    else:  # a circle inside the disk of the points already seen
        reach = max(((a - ty) ** 2 + (b - tx) ** 2) ** 0.5 for a, b in have)
        sure = ((cy - ty) ** 2 + (cx - tx) ** 2) ** 0.5 + r2**0.5 < reach * (1 - 1e-9)
    return (ty, tx, *corners.ravel().tolist(), cy, cx, r2, bool(sure or r2 > FLAT))


def _batch(rows: list):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in STATE.names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "sure" else pa.float64()) for c, n in zip(columns, STATE.names)], names=STATE.names)
