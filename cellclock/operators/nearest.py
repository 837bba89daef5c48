"""Nearest cells and points. All searches run over equi-joins on tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.grid import Grid
from cellclock.names import q
from cellclock.operators.keyed import lookup
from cellclock.operators.pyramid import nearest_pairs
from cellclock.session import cut

MAX_RADIUS = 200  # fixed value: cells searched around a strike
CELL_KM = 4  # fixed value: edge of a cell


# ---- nearest flagged cell of the same scene ----------------------------------


def _search_tile(requests: pd.DataFrame, flags: pd.DataFrame, radius: int, ring: bool) -> pd.DataFrame:
    """Nearest flagged cell of each requested cell, for the scenes of one group.

    Scenes are laid out one below the other with a gap wider than the search. In
    every raster row only the closest flag to the left and to the right can win, so
    those are computed once and the rows are then scanned outwards.
    """
    scene = requests.columns[0]
    code, _ = pd.factorize(pd.concat([requests[scene], flags[scene]], ignore_index=True))
    rows, cols = requests["row"].to_numpy(np.int64), requests["col"].to_numpy(np.int64)
    fr, fc = flags["row"].to_numpy(np.int64), flags["col"].to_numpy(np.int64)
    r0, c0 = min(rows.min(), fr.min()), min(cols.min(), fc.min())
    high, width = max(rows.max(), fr.max()) - r0 + 1, max(cols.max(), fc.max()) - c0 + 1
    reach = int(min(radius, high - 1))
    pitch = high + reach
    y, x = code[: len(rows)] * pitch + reach + rows - r0, cols - c0
    flagged = np.zeros(((code.max() + 1) * pitch + reach, width), bool)
    flagged[code[len(rows) :] * pitch + reach + fr - r0, fc - c0] = True
    far = np.int32(radius + width + 1)  # outside the search from any column
    at = np.arange(width, dtype=np.int32)
    left = np.maximum.accumulate(np.where(flagged, at, -far), axis=1)
    right = np.minimum.accumulate(np.where(flagged, at, width + far)[:, ::-1], axis=1)[:, ::-1]

    # One sortable number per candidate: (ring or 0, squared distance, row, col).
    side = 2 * radius + 1
    worst = np.iinfo(np.int64).max
    best = np.full(len(rows), worst)
    open_ = np.arange(len(rows))
    for step in range(reach + 1):
        for dy in {step, -step}:
            for nearest in (left, right):
                dx = nearest[y[open_] + dy, x[open_]] - x[open_]
                rank = np.maximum(abs(dy), np.abs(dx)) if ring else 0
                key = ((rank * (2 * side * side) + dy * dy + dx * dx) * side + (dy + radius)) * side + (dx + radius)
                best[open_] = np.where(np.abs(dx) <= radius, np.minimum(best[open_], key), best[open_])
        # Rows further out lose against anything found within this distance.
        found = best[open_] // (side * side)
        bound = found // (2 * side * side) if ring else np.sqrt(found)
        open_ = open_[(best[open_] == worst) | (bound > step)]
        if not len(open_):
            break
    hit = best < worst
    dx = best[hit] % side - radius
    dy = best[hit] // side % side - radius
    out = requests[hit].copy()
    out["near_row"], out["near_col"] = rows[hit] + dy, cols[hit] + dx
    out["distance_km"] = CELL_KM * np.sqrt((dy**2 + dx**2).astype(float))
    return out


def nearest_cloud_cell(
    df: DataFrame,
    mask: DataFrame,
    max_radius: int = MAX_RADIUS,
    metric: str = "ring",
    scene: str = "ts",
    tile: int = 512,
    hours: int = 3,
) -> DataFrame:
    """Nearest flagged cell of the row's scene within a square of ``max_radius``:
    near_row, near_col, distance_km; NULL when the scene is absent or holds none.

    ``ring`` takes the smallest square ring first, then the Euclidean distance,
    then row-major order; ``euclid`` the distance, then row-major order.

    Requests are reduced to distinct cells and both sides to tiles of the scenes of
    a few hours; flags within reach are copied to the neighbour tiles. A group then
    holds at most (tile + 2 * max_radius)^2 cells per scene, whatever the number of
    strikes or how much of a scene is flagged.
    """
    if metric not in ("ring", "euclid"):
        raise ValueError(f"unknown metric: {metric}")
    ring = metric == "ring"
    keys = [scene, "row", "col"]

    def tile_of(c: str, shift: int = 0) -> Column:
        return F.floor((F.col(c) + shift) / tile).cast("int")

    requests = df.select(*keys).distinct().withColumns({"_tr": tile_of("row"), "_tc": tile_of("col")})

    def reached(c: str) -> Column:
        return F.explode(F.sequence(tile_of(c, -max_radius), tile_of(c, max_radius)))

    flags = mask.select(*keys).distinct()
    flags = flags.select("*", reached("row").alias("_tr")).select("*", reached("col").alias("_tc"))
    fields = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keys) + ", near_row int, near_col int, distance_km double"

    def search(wanted: pd.DataFrame, flagged: pd.DataFrame) -> pd.DataFrame:
        return _search_tile(wanted[keys], flagged, max_radius, ring)

    # Only tiles with both sides go to Python: most scenes have no strike at all.
    both = [scene, "_tr", "_tc"]
    asked, held = requests.select(*both).distinct(), flags.select(*both).distinct()
    flags = flags.join(asked, both, "left_semi")
    requests = requests.join(held, both, "left_semi")
    span = F.floor(F.unix_seconds(F.col(scene).cast("timestamp")) / (3600 * hours))
    requests, flags = requests.withColumn("_span", span), flags.withColumn("_span", span)
    parts = ["_span", "_tr", "_tc"]
    # A fixed number of partitions: the work of a tile does not show in its bytes.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    requests, flags = requests.repartition(n, *parts), flags.repartition(n, *parts)
    found = requests.groupBy(*parts).cogroup(flags.groupBy(*parts)).applyInPandas(search, schema)
    return lookup(df, found, keys)


# ---- nearest points of cells ------------------------------------------------------


def _positions(points: DataFrame, y: Column, x: Column, payload: Column) -> DataFrame:
    """Distinct positions with the smallest payload; a crowded place is one row by then."""
    placed = points.select(y.cast("double").alias("_y"), x.cast("double").alias("_x"), payload.alias("_p"))
    placed = placed.where(F.col("_y").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_y") & ~F.isnan("_x"))
    return placed.groupBy("_y", "_x").agg(F.min("_p").alias("_p"), F.lit(1).cast("long").alias("_n"))


def nearest_regrid(
    points: DataFrame,
    grid: Grid,
    max_radius: float | None = None,
    fill: float | None = -9999.0,
    tie: str = "id",
) -> DataFrame:
    """Irregular (lon, lat, value) points to the grid: each cell takes the point
    nearest to its centre (Euclid in cells, lowest ``tie`` first). Beyond
    ``max_radius`` cells the value is ``fill``; without a radius the search goes on
    until every cell is served.

    Points at one place are one position; cells find their candidates in a pyramid of
    tiles, where a crowded bin is split only towards the cells that may want it.
    """
    spark = points.sparkSession
    y = (F.lit(grid.lat0) - F.col("lat")) / F.lit(grid.dy)
    x = (F.col("lon") - F.lit(grid.lon0)) / F.lit(grid.dx)
    places = cut(_positions(points, y, x, F.struct(q(tie).alias("tie"), F.col("value").cast("double").alias("v"))))
    cells = spark.range(grid.height * grid.width).select(
        F.floor(F.col("id") / grid.width).cast("int").alias("row"),
        F.pmod("id", F.lit(grid.width)).cast("int").alias("col"),
    )
    centres = cells.select((F.col("row") + 0.5).alias("_y"), (F.col("col") + 0.5).alias("_x"))
    near = nearest_pairs(centres, places, 1, max_radius)
    ey, ex = F.col("_y") - F.col("_ty"), F.col("_x") - F.col("_tx")
    best = near.join(places, ["_y", "_x"]).groupBy("_ty", "_tx").agg(
        F.min(F.struct((ey * ey + ex * ex).alias("d2"), F.col("_p.tie").alias("tie"), F.col("_p.v").alias("v"))).alias("_b")
    )
    value = F.col("_b.v") if max_radius is None else F.when(F.col("_b.d2") <= max_radius**2, F.col("_b.v"))
    named = best.select((F.col("_ty") - 0.5).cast("int").alias("row"), (F.col("_tx") - 0.5).cast("int").alias("col"), value.alias("_v"))
    return cells.join(named, ["row", "col"], "left").select("row", "col", F.coalesce("_v", F.lit(fill).cast("double")).alias("value"))


def nearest_neighbours(
    points: DataFrame, k: int, columns: Sequence[str], key: str = "id"
) -> DataFrame:
    """The k nearest other points of each point on the cell grid (``row``, ``col``),
    by Euclidean distance, lowest ``key`` first among equals: every input row with
    ``neighbours``, an array of structs (d2, key, columns…).

    All points of a cell see the same distances, so the search runs per occupied
    cell and for k+1 candidates (one may be the point itself); of a crowded cell
    only its k+1 lowest keys can be candidates, a rank filter that is applied before
    the shuffle, so a hot cell never travels. Cells find the cells that can hold their
    k+1 candidates in a pyramid of tiles.
    """
    need = k + 1
    first = F.row_number().over(Window.partitionBy("row", "col").orderBy(key))
    reps = points.select("row", "col", key, *[q(c) for c in columns]).where("row IS NOT NULL AND col IS NOT NULL")
    reps = cut(reps.withColumn("_rn", first).where(F.col("_rn") <= need).drop("_rn"))
    cells = cut(reps.groupBy(F.col("row").cast("double").alias("_y"), F.col("col").cast("double").alias("_x")).agg(F.count("*").alias("_n")))
    near = nearest_pairs(cells.select("_y", "_x"), cells, need)
    near = near.select(*[F.col(c).cast(t).alias(n) for c, n, t in (("_ty", "row", reps.schema["row"].dataType), ("_tx", "col", reps.schema["col"].dataType), ("_y", "_r", "long"), ("_x", "_c", "long"))])
    dr, dc = F.col("row") - F.col("_r"), F.col("col") - F.col("_c")
    candidates = reps.select(
        F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.struct(q(key).alias("key"), *[q(c).alias(c) for c in columns]).alias("_p")
    )
    found = near.join(candidates, ["_r", "_c"]).withColumn("_d2", (dr * dr + dc * dc).cast("long"))
    rank = F.row_number().over(Window.partitionBy("row", "col").orderBy("_d2", "_p.key"))
    entry = F.struct(F.col("_d2").alias("d2"), F.col("_p.key").alias("key"), *[F.col("_p").getField(c).alias(c) for c in columns])
    top = found.withColumn("_rn", rank).where(F.col("_rn") <= need)
    lists = top.groupBy("row", "col").agg(F.array_sort(F.collect_list(entry)).alias("_list"))  # k + 1 entries
    others = F.slice(F.filter("_list", lambda n: n["key"] != q(key)), 1, k)
    return points.join(lists, ["row", "col"], "left").withColumn("neighbours", others).drop("_list")
