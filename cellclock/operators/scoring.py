"""Feature scores that need no model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.functions.special import correlation_p_value, digamma, pearson
from cellclock.names import HISTORY, lag_columns, lag_name, q
from cellclock.operators.keyed import lookup
from cellclock.operators.lookups import rank_join
from cellclock.operators.nearest import nearest_neighbours
from cellclock.operators.ordered import number_rows, running_total
from cellclock.operators.profile import feature_rank_sum, valid
from cellclock.session import cut

BAND_OF = r"_t[+-]\d+$"


def _columns_to_rows(row: DataFrame, columns: Sequence[str], **fields: str) -> DataFrame:
    """A one-row aggregate ``<prefix><i>`` per column -> rows feature, fields…"""
    cells = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{prefix}{i}").alias(name) for name, prefix in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def point_biserial_features(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """|corr| with the label and two-sided p-value per column, in one pass over the
    pairwise complete rows."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(valid(q(c).cast("double")) & q(label).isNotNull(), q(c).cast("double"))
        aggs += [pearson(v, q(label).cast("double")).alias(f"r{i}"), F.count(v).alias(f"n{i}")]
    rows = _columns_to_rows(df.agg(*aggs), columns, r="r", n="n")
    return rows.select("feature", F.abs("r").alias("corr"), correlation_p_value("r", "n").alias("p_value"))


def point_biserial(df: DataFrame, bands: Sequence[str], label: str, offsets: Sequence[int] = HISTORY) -> DataFrame:
    """Mean over a band's lags, best band first."""
    per = point_biserial_features(df, lag_columns(bands, offsets), label)
    band = F.regexp_replace("feature", BAND_OF, "")
    means = per.groupBy(band.alias("band")).agg(F.avg("corr").alias("corr"), F.avg("p_value").alias("p_value"))
    return means.orderBy(F.desc("corr"), "band")


# ---- mutual information -----------------------------------------------------


def _long(df: DataFrame, columns: Sequence[str], label: str, key: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias("x")) for c in columns]
    rows = df.select(F.col(key).alias("_key"), q(label).alias("_y"), F.explode(F.array(*cells)).alias("_c"))
    rows = rows.select("_key", "_y", "_c.feature", "_c.x")
    return rows.where(valid(F.col("x")) & F.col("_y").isNotNull())


def mutual_information_features(
    df: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 3, block: int = 50_000
) -> DataFrame:
    """Mutual information of each continuous column with a discrete label, from
    nearest neighbours in one dimension (Ross 2014):

        psi(N) + <psi(k)> - <psi(N_y)> - <psi(m)>

    where m counts all points closer than the k-th neighbour of the same label.
    Where that distance is 0 the tied points are counted instead (Gao et al. 2017),
    which makes the result independent of any jitter. Labels seen once are left out.

    No pairs are formed. Neighbours come from a window over numbered rows, cut in
    blocks with k rows of overlap; m is the difference of two running counts over
    the points and the interval ends in one range-partitioned order.
    """
    long = _long(df, columns, label, key)
    sizes = long.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("_ny"))
    points = lookup(long, sizes.where("_ny > 1"), ["feature", "_y"], "inner")
    points = points.withColumn("_k", F.least(F.lit(k), F.col("_ny") - 1).cast("int"))

    # k-th neighbour of the same label: within k places in the sorted order.
    placed = number_rows(points, ["x", "_key"], "_rn", ["feature", "_y"])
    own = F.floor((F.col("_rn") - 1) / block)
    pos = F.pmod(F.col("_rn") - 1, F.lit(block))
    blocks = F.array_compact(F.array(own, F.when(pos < k, own - 1), F.when(pos >= block - k, own + 1)))
    spread = placed.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    w = Window.partitionBy("feature", "_y", "_blk").orderBy("_rn")
    gaps = []
    for d in range(1, k + 1):
        for other in (F.lag("x", d).over(w), F.lead("x", d).over(w)):
            gaps.append(F.when(other.isNotNull(), F.struct(F.abs(F.col("x") - other).alias("r"), other.alias("v"))))
    ranked = F.array_sort(F.array_compact(F.array(*gaps)))
    spread = spread.withColumn("_gaps", ranked).where(F.col("_blk") == F.col("_own"))
    at, kth = F.col("x"), F.col("_kth")
    spread = spread.withColumn("_kth", F.element_at("_gaps", F.col("_k")))
    # The k-th neighbour itself is one end of the interval, without rounding.
    radius = spread.select(
        "feature", "_y", "_key", "x", "_ny", "_k", kth["r"].alias("_r"),
        F.when(kth["v"] <= at, kth["v"]).otherwise(at - kth["r"]).alias("_lo"),
        F.when(kth["v"] >= at, kth["v"]).otherwise(at + kth["r"]).alias("_hi"),
    )
    radius = cut(radius)

    # Distinct places: points, and both ends of each open interval.
    zero = F.col("_r") == 0
    ends = F.array(
        F.struct(at.alias("v"), F.lit(1).alias("n")),
        F.struct(F.col("_lo").alias("v"), F.lit(0).alias("n")),
        F.struct(F.col("_hi").alias("v"), F.lit(0).alias("n")),
    )
    places = radius.select("feature", F.explode(ends).alias("_e")).groupBy("feature", F.col("_e.v").alias("_v")).agg(
        F.sum("_e.n").alias("_n")
    )
    counts = running_total(places, ["_v"], {"_upto": "_n"}, ["feature"])
    # Points < v and points <= v.
    counts = counts.select("feature", "_v", (F.col("_upto") - F.col("_n")).alias("_below"), "_upto")
    ties = radius.groupBy("feature", "_y", "x").agg(F.count(F.lit(1)).alias("_same"))
    low = counts.select("feature", F.col("_v").alias("_lo"), F.col("_below").alias("_b_lo"), F.col("_upto").alias("_u_lo"))
    high = counts.select("feature", F.col("_v").alias("_hi"), F.col("_below").alias("_b_hi"), F.col("_upto").alias("_u_hi"))
    # Equal rows are answered once.
    unique = radius.groupBy("feature", "_y", "x", "_ny", "_k", "_r", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_times"))
    answered = unique.join(low, ["feature", "_lo"]).join(high, ["feature", "_hi"]).join(ties, ["feature", "_y", "x"])
    m = F.when(zero, F.col("_u_hi") - F.col("_b_lo")).otherwise(F.col("_b_hi") - F.col("_u_lo"))
    kk = F.when(zero, F.col("_same")).otherwise(F.col("_k"))
    term = (digamma(kk) - digamma(F.col("_ny")) - digamma(F.greatest(m, F.lit(1)))) * F.col("_times")
    out = answered.groupBy("feature").agg(F.sum(term).alias("_t"), F.sum("_times").alias("_n"))
    mi = digamma(F.col("_n")) + F.col("_t") / F.col("_n")
    return out.select("feature", F.greatest(F.lit(0.0), mi).alias("mi"))


def mutual_information(
    df: DataFrame, bands: Sequence[str], label: str, key: str, offsets: Sequence[int] = HISTORY, k: int = 3
) -> DataFrame:
    """The best lag of each band, best band first."""
    per = mutual_information_features(df, lag_columns(bands, offsets), label, key, k)
    band = F.regexp_replace("feature", BAND_OF, "")
    return per.groupBy(band.alias("feature")).agg(F.max("mi").alias("MI_score")).orderBy(F.desc("MI_score"), "feature")


TILE = 1024  # points of a tile
PAIRS = 128  # pairs of tiles of a task, more or less


def _distances(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Largest coordinate differences of all rows of ``x`` and ``other``."""
    d = np.zeros((len(x), len(other)))
    for j in range(x.shape[1]):
        np.maximum(d, np.abs(x[:, j, None] - other[None, :, j]), out=d)
    return d


def _nearest(d: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` smallest distances of each row, a point of weight w counting w times;
    infinite where there are fewer."""
    if d.shape[1] > most:  # every point counts at least once, so no more are needed
        some = np.argpartition(d, most - 1, axis=1)[:, :most]
        d, weight = np.take_along_axis(d, some, axis=1), weight[some]
    else:
        weight = np.broadcast_to(weight, d.shape)
    first = np.argsort(d, axis=1, kind="stable")
    near = np.hstack([np.take_along_axis(d, first, axis=1), np.full((len(d), 1), np.inf)])
    upto = np.cumsum(np.take_along_axis(weight, first, axis=1), axis=1)
    return np.stack([near[np.arange(len(d)), (upto <= j).sum(axis=1)] for j in range(most)], axis=1)


def _tiles(points: DataFrame, dims: int, size: int) -> DataFrame:
    """Points (feature, _y, _x, _w, _ny) as rows of at most ``size`` points of one class
    and their box: slabs of the widest lag, each cut by the next widest."""
    at = lambda i: F.get("_x", F.lit(i))
    widths = F.array(*[F.struct((F.max(at(i)) - F.min(at(i))).alias("w"), F.lit(i).alias("i")) for i in range(dims)])
    widest = points.groupBy("feature").agg(F.sort_array(widths, asc=False)["i"].alias("_wide"))
    counts = points.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("_m"))
    by = lookup(lookup(points, widest, ["feature"], "inner"), counts, ["feature", "_y"], "inner")
    by = by.withColumns({"_v1": F.get("_x", F.get("_wide", F.lit(0))), "_v2": F.get("_x", F.get("_wide", F.lit(min(1, dims - 1))))})
    slabs = F.ceil(F.sqrt(F.ceil(F.col("_m") / size)))
    by = number_rows(by, ["_v1", "_x"], "_rn", ["feature", "_y"]).withColumn("_slab", F.floor((F.col("_rn") - 1) / F.ceil(F.col("_m") / slabs)))
    by = number_rows(by.drop("_rn"), ["_v2", "_x"], "_rn", ["feature", "_y", "_slab"]).withColumn("_no", F.floor((F.col("_rn") - 1) / size))
    held = by.groupBy("feature", "_y", "_slab", "_no").agg(
        F.first("_ny").alias("_ny"),
        F.collect_list(F.struct("_x", "_w")).alias("_p"),
        F.array(*[F.min(at(i)) for i in range(dims)]).alias("_lo"),
        F.array(*[F.max(at(i)) for i in range(dims)]).alias("_hi"),
    )
    slab = F.concat_ws("/", "feature", "_y", "_slab")
    return held.select(
        "feature", "_y", slab.alias("_s"), F.concat_ws("/", slab, "_no").alias("_t"), "_ny", "_lo", "_hi",
        F.flatten("_p._x").alias("_xs"), F.col("_p._w").alias("_ws"), F.aggregate("_p._w", F.lit(0).cast("long"), lambda n, w: n + w).alias("_all"),
    )


def _apart(a: str, b: str, far: bool = False) -> Column:
    """Least, or largest, largest-coordinate distance between two boxes, given by the
    prefixes of their _lo and _hi."""
    one = F.zip_with(f"{b}_lo", f"{a}_hi", lambda x, y: x - y)
    two = F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: x - y)
    if far:  # the largest extent of both boxes together
        return -F.array_min(F.zip_with(one, two, lambda x, y: F.least(x, y)))
    return F.greatest(F.lit(0.0), F.array_max(F.zip_with(one, two, lambda x, y: F.greatest(x, y))))


def _tile_pairs(tiles: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """(_t, o_t, whole) of every tile and every one that its points' reach ``_r`` may
    touch. Slabs, about as many as the square root of the tiles, are compared first, then
    the tiles of slabs in reach of each other; both by joins on keys, so no list of boxes
    is sent around. ``whole``: every point of the second is nearer than each reach of the first."""
    boxes = tiles.select("feature", "_y", "_s", "_t", "_lo", "_hi", "_all", F.array_max("_r").alias("_far"), F.array_min("_r").alias("_least"))
    ends = [F.array(*[f(F.get(c, F.lit(i))) for i in range(dims)]).alias(c) for f, c in ((F.min, "_lo"), (F.max, "_hi"))]
    slabs = cut(boxes.groupBy("feature", "_y", "_s").agg(*ends, F.max("_far").alias("_far")))
    others = slabs.select(*keys, *[F.col(c).alias(f"o{c}") for c in ("_s", "_lo", "_hi")])
    near = slabs.join(others, list(keys)).where(_apart("", "o") <= F.col("_far")).select("_s", "o_s")
    second = boxes.select(*[F.col(c).alias(f"o{c}") for c in ("_s", "_t", "_lo", "_hi", "_all")])
    pairs = boxes.join(near, "_s").join(second, "o_s").where(_apart("", "o") <= F.col("_far"))
    return pairs.select("_t", "o_t", "o_all", ((_apart("", "o", True) < F.col("_least")) & (F.col("_least") > 0)).alias("whole"))


def _with_points(pairs: DataFrame, tiles: DataFrame, tasks: int) -> DataFrame:
    """Pairs of tiles with what both hold; the second has the prefix ``o``. Few pairs are
    sent to the first tiles, which therefore stand in ``tasks`` partitions."""
    own = tiles.select("_t", "_ny", "_xs", "_ws", "_r").repartition(tasks, "_t")
    return pairs.join(own, "_t").join(tiles.select(*[F.col(c).alias(f"o{c}") for c in ("_t", "_xs", "_ws", "_lo", "_hi")]), "o_t")


def mutual_information_joint(
    df: DataFrame, bands: Sequence[str], label: str, key: str, offsets: Sequence[int] = HISTORY, k: int = 3, tile: int = TILE
) -> DataFrame:
    """Mutual information of all lags of a band together, in the published form of
    Ross (2014) under the largest-coordinate distance; rows of a class of their own are
    left out.

    All rows count, equal ones as one point with a weight. Points lie in tiles of at most
    ``tile`` points of one class. A point's own tile bounds the distance of its k-th
    neighbour, so only tiles whose boxes are in reach are compared: those of its class for
    the neighbour, then all for the points that are closer; there, tiles that lie whole
    within the reach of all points of a tile count by their size, and only those on the
    border are opened. A task holds a few tile pairs.
    """
    dims = len(offsets)
    each = F.array(*[F.struct(F.lit(b).alias("feature"), F.array(*[q(c).cast("double") for c in lag_columns([b], offsets)]).alias("_x")) for b in bands])
    rows = df.where(q(label).isNotNull()).select(q(label).cast("int").alias("_y"), F.explode(each).alias("_e")).select("_e.feature", "_y", "_e._x")
    points = cut(rows.where(F.forall("_x", valid)).groupBy("feature", "_y", "_x").agg(F.count(F.lit(1)).alias("_w")))
    sizes = points.groupBy("feature", "_y").agg(F.sum("_w").alias("_ny")).where("_ny > 1")
    tiles = cut(_tiles(lookup(points, sizes, ["feature", "_y"], "inner"), dims, tile))

    def matrix(flat) -> np.ndarray:
        return np.asarray(flat, float).reshape(-1, dims)

    def bounds(held):
        for part in held:
            reach = []
            for xs, ws, ny in zip(part["_xs"], part["_ws"], part["_ny"]):
                x, want = matrix(xs), min(k, ny - 1)
                reach.append(_nearest(_distances(x, x), np.asarray(ws), want + 1)[:, want])
            yield part.assign(_r=reach)

    def in_reach(row):
        """Points of a tile, their numbers and reach, that may have others in the box, and
        the points and weights of the other tile that may be in reach of one of them."""
        x, r = matrix(row["_xs"]), np.asarray(row["_r"], float)
        gap = np.maximum(np.asarray(row["o_lo"]) - x, x - np.asarray(row["o_hi"])).max(axis=1)
        at = np.flatnonzero(gap <= r)
        x, r = x[at], r[at]
        if not len(at):
            return x, at, r, x, r
        other, weight = matrix(row["o_xs"]), np.asarray(row["o_ws"])
        near = np.maximum(x.min(axis=0) - other, other - x.max(axis=0)).max(axis=1) <= r.max()
        return x, at, r, other[near], weight[near]

    def neighbours(held):
        for part in held:
            found = []
            for row in part.to_dict("records"):
                x, at, r, other, weight = in_reach(row)
                if len(weight):
                    near = _nearest(_distances(x, other), weight, min(k, row["_ny"] - 1) + 1)
                    found += [(row["_t"], i, d[d <= b]) for i, b, d in zip(at, r, near)]
            yield pd.DataFrame(found, columns=["_t", "_i", "_d"])

    def closer(held):
        for part in held:
            found = []
            for row in part.to_dict("records"):
                x, at, r, other, weight = in_reach(row)
                if len(weight):
                    d = _distances(x, other)
                    inside = np.where(r[:, None] > 0, d < r[:, None], d == 0) @ weight
                    found += [(row["_t"], i, n) for i, n in zip(at, inside) if n]
            yield pd.DataFrame(found, columns=["_t", "_i", "_n"])

    conf = df.sparkSession.conf
    # A row holds the points of two tiles. Its work does not show in its bytes, as copies of
    # a tile compress well, so tasks are made by the number of pairs and not coalesced.
    changed = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: conf.get(name) for name in changed}

    def opened(pairs, tiles, work, schema):
        """Pairs of tiles with what they hold, put through ``work``, written."""
        tasks = max(int(before["spark.sql.shuffle.partitions"]), -(-pairs.count() // PAIRS))
        conf.set("spark.sql.shuffle.partitions", str(tasks))
        conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = cut(_with_points(pairs, tiles, tasks).mapInPandas(work, schema))
        for name in changed[1:]:
            conf.set(name, before[name])
        return out

    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema)
        parts = max(int(before[changed[1]]), -(-tiles.count() // PAIRS))
        bounded = cut(tiles.repartition(parts, "_t").mapInPandas(bounds, f"{schema}, _r array<double>"))
        near = cut(_tile_pairs(bounded, ["feature", "_y"], dims).select("_t", "o_t"))
        found = opened(near, bounded, neighbours, "_t string, _i int, _d array<double>")
        nearest = found.groupBy("_t", "_i").agg(F.sort_array(F.flatten(F.collect_list("_d"))).alias("_d"))
        nearest = nearest.join(bounded.select("_t", F.least(F.lit(k), F.col("_ny") - 1).cast("int").alias("_want")), "_t")
        radius = nearest.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("_i", F.get("_d", F.col("_want")).alias("_r"))))["_r"].alias("_r"))
        reached = cut(bounded.drop("_r").join(radius, "_t"))
        touched = cut(_tile_pairs(reached, ["feature"], dims))
        border = touched.where("NOT whole").select("_t", "o_t")
        counts = opened(border, reached, closer, "_t string, _i int, _n bigint")
    finally:
        for name, value in before.items():
            conf.set(name, value)
    each_point = reached.select("_t", "feature", "_ny", F.posexplode(F.arrays_zip("_ws", "_r")).alias("_i", "_e"))
    inside = touched.where("whole").groupBy("_t").agg(F.sum("o_all").alias("_whole"))
    counted = each_point.join(counts.groupBy("_t", "_i").agg(F.sum("_n").alias("_n")), ["_t", "_i"], "left").join(inside, "_t", "left")
    counted = counted.withColumn("_n", F.coalesce("_n", F.lit(0)) + F.coalesce("_whole", F.lit(0)))
    w = F.col("_e._ws")
    used = F.when(F.col("_e._r") > 0, F.least(F.lit(k), F.col("_ny") - 1)).otherwise(w)
    terms = F.sum(w * (digamma(used) - digamma(F.col("_ny")) - digamma(F.col("_n"))))
    mi = digamma(F.sum(w)) + terms / F.sum(w)
    # A band without rows scores like one of whose rows nothing is known.
    named = df.sparkSession.createDataFrame([(b,) for b in bands], "feature string")
    scores = counted.groupBy("feature").agg(F.greatest(F.lit(0.0), mi).alias("MI_score"))
    return named.join(scores, "feature", "left").select("feature", F.coalesce("MI_score", F.lit(0.0)).alias("MI_score")).orderBy(F.desc("MI_score"), "feature")


# ---- spatial autocorrelation ------------------------------------------------


def morans_i_features(df: DataFrame, columns: Sequence[str], k: int, key: str = "id") -> DataFrame:
    """Moran's I of each column under row-standardised k-nearest weights on the cell
    grid. Neighbours are found once for all columns. ``df``: key, row, col, columns."""
    near = nearest_neighbours(df.select(key, "row", "col", *[q(c) for c in columns]), k, columns, key)
    means = df.agg(F.struct(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)])).scalar()

    def index(c: str, mean: Column) -> Column:
        z = q(c) - mean
        around = F.aggregate("neighbours", F.lit(0.0), lambda total, n: total + n[c]) / F.size("neighbours") - mean
        return F.try_divide(F.sum(z * around), F.sum(z * z))

    aggs = [index(c, means.getField(f"m{i}")).alias(f"i{i}") for i, c in enumerate(columns)]
    return _columns_to_rows(near.agg(*aggs), columns, I="i")


def morans_i(df: DataFrame, bands: Sequence[str], k: int, offsets: Sequence[int] = HISTORY, key: str = "id") -> DataFrame:
    """Highest I over a band's lags, best band first."""
    per = morans_i_features(df, lag_columns(bands, offsets), k, key)
    band = F.regexp_replace("feature", BAND_OF, "")
    return per.groupBy(band.alias("band")).agg(F.max("I").alias("I")).orderBy(F.desc("I"), "band")


def consensus_rank(*rankings: DataFrame, top: int = 20, skip_first: bool = True) -> DataFrame:
    """Sum of band ranks over several feature rankings (feature, position), lowest
    first."""
    joined = rank_join(*[feature_rank_sum(r, skip_first) for r in rankings])
    ranks = [F.col(f"rank_{i}") for i in range(1, len(rankings) + 1)]
    points = ranks[0]
    for r in ranks[1:]:
        points = points + r
    return joined.withColumn("points", points).orderBy("points", "feature").limit(top)
