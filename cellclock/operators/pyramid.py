"""Nearest positions by an adaptive pyramid of tiles.

Targets and sources are positions in the plane. Both are laid into square tiles whose sides
are halved from level to level. A pair of a target tile and a source tile has a lower and an
upper distance; the ``need`` nearest sources of every target in a tile lie within the
smallest upper distance that ``need`` of them reach, so source tiles further away are left
out before they are split. Below the level where a tile holds one target, only source tiles
that are still candidates and crowded are split, and a position is looked at once for each
level, whatever the number of targets that want its tile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.session import cut

LEAF = 32  # positions of a tile that is not split any more
DEEPEST = 44  # levels below the side of one
_BOX = ("y0", "y1", "x0", "x1")


def _key(c: str, origin: float, side: float) -> Column:
    return F.floor((F.col(c) - F.lit(origin)) / F.lit(side)).cast("long")


def _box(prefix: str, y: str = "_y", x: str = "_x") -> list[Column]:
    return [f(c).alias(f"{prefix}{n}") for n, (f, c) in zip(_BOX, ((F.min, y), (F.max, y), (F.min, x), (F.max, x)))]


def _apart2(near: bool) -> Column:
    """Square of the least or the largest distance between the boxes of a pair."""
    parts = []
    for a in "yx":
        low, high = F.col(f"s{a}0") - F.col(f"t{a}1"), F.col(f"s{a}1") - F.col(f"t{a}0")
        d = F.greatest(low, -high, F.lit(0.0)) if near else F.greatest(high, -low)
        parts.append(d * d)
    return parts[0] + parts[1]


def _kept(pairs: DataFrame, need: int, radius2: float | None) -> DataFrame:
    """Pairs that may hold one of the ``need`` nearest sources of a target.

    The pairs of a target tile are few: those that its parent kept, and their children."""
    pairs = pairs.withColumns({"_near": _apart2(True), "_far": _apart2(False)})
    if radius2 is not None:
        pairs = pairs.where(F.col("_near") <= radius2)
    target = Window.partitionBy("ty", "tx")
    nearest_first = target.orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = pairs.withColumn("_reached", F.sum("sn").over(nearest_first))
    bound = F.min(F.when(F.col("_reached") >= need, F.col("_far"))).over(target)
    return reached.withColumn("_bound", bound).where("_bound IS NULL OR _near <= _bound").drop("_near", "_far", "_reached", "_bound")


def nearest_pairs(targets: DataFrame, sources: DataFrame, need: int = 1, radius: float | None = None, leaf: int = LEAF) -> DataFrame:
    """(_ty, _tx, _y, _x) of every target and each source that may be among its ``need``
    nearest, ties included; both tables hold distinct positions (_y, _x), sources also a
    weight ``_n`` that counts towards ``need``. Sources further than ``radius`` are left out.

    Targets must be at least one apart along some axis, as cells are, or are searched
    together where they share a tile of side one. Per target a bounded number of pairs is
    left at every level, and of a crowded tile only the parts near the target are split.
    ``sources`` is read once for each level below one and should be a stored table.
    """
    spark = targets.sparkSession
    ends = [F.min("_y").alias("a"), F.max("_y").alias("b"), F.min("_x").alias("c"), F.max("_x").alias("d")]
    s, t = sources.agg(*ends).first(), targets.agg(*ends).first()
    if s["a"] is None or t["a"] is None:
        return spark.createDataFrame([], "_ty double, _tx double, _y double, _x double")
    oy, ox = (math.floor(min(s[c], t[c])) for c in "ac")
    span = max(max(s["b"], t["b"]) - oy, max(s["d"], t["d"]) - ox) + 1
    top = max(1, math.ceil(math.log2(span)))

    bins = sources.groupBy(_key("_y", oy, 1.0).alias("_by"), _key("_x", ox, 1.0).alias("_bx")).agg(
        F.sum("_n").alias("sn"), F.count("*").alias("sm"), *_box("s")
    )
    bins = cut(bins)  # bounded by the area

    def source_tiles(level: int, above: int) -> DataFrame:
        shift = lambda c, n: F.shiftright(c, n)
        merged = [F.sum("sn").alias("sn"), F.sum("sm").alias("sm"), *[f(f"s{n}").alias(f"s{n}") for n, f in zip(_BOX, (F.min, F.max) * 2)]]
        up = top - level
        tiles = bins.groupBy(shift("_by", up).alias("sy"), shift("_bx", up).alias("sx")).agg(*merged) if up else bins.withColumnsRenamed({"_by": "sy", "_bx": "sx"})
        return tiles.withColumns({"spy": shift("sy", level - above), "spx": shift("sx", level - above)})

    def target_tiles(level: int, above: int) -> DataFrame:
        side = 2.0 ** (top - level)
        tiles = targets.groupBy(_key("_y", oy, side).alias("ty"), _key("_x", ox, side).alias("tx")).agg(*_box("t"))
        return tiles.withColumns({"tpy": F.shiftright("ty", level - above), "tpx": F.shiftright("tx", level - above)})

    # Two levels at a time while tiles are few, then one.
    levels, at = [], 0
    while at < top:
        at += 2 if at + 2 <= top - 3 else 1
        levels.append(at)
    pairs, above = None, 0
    for level in levels:
        st, tt = source_tiles(level, above), target_tiles(level, above)
        if pairs is None:  # both tables hold the few parts of the one tile above
            both = tt.join(st, (tt.tpy == st.spy) & (tt.tpx == st.spx))
        else:
            parents = pairs.select(F.col("ty").alias("tpy"), F.col("tx").alias("tpx"), F.col("sy").alias("spy"), F.col("sx").alias("spx"))
            both = parents.join(tt, ["tpy", "tpx"]).join(st, ["spy", "spx"])
        pairs = _kept(both.drop("tpy", "tpx", "spy", "spx"), need, None if radius is None else radius * radius)
        above = level
    pairs = cut(pairs)

    # Crowded tiles that are still wanted are split, sixteen parts at a time.
    done, level = [(top, pairs.where(F.col("sm") <= leaf))], top
    open_pairs = pairs.where(F.col("sm") > leaf)
    while level < top + DEEPEST and not open_pairs.isEmpty():
        level += 2
        side, parent = 2.0 ** (top - level), 2.0 ** (top - level + 2)
        wanted = open_pairs.select(F.struct("sy", "sx").alias("_k")).distinct()
        held = sources.withColumn("_k", F.struct(_key("_y", oy, parent).alias("sy"), _key("_x", ox, parent).alias("sx"))).join(wanted, "_k")
        parts = held.groupBy("_k", _key("_y", oy, side).alias("cy"), _key("_x", ox, side).alias("cx")).agg(F.sum("_n").alias("sn"), F.count("*").alias("sm"), *_box("s"))
        split = open_pairs.select("ty", "tx", *[f"t{n}" for n in _BOX], F.struct("sy", "sx").alias("_k")).join(parts, "_k").drop("_k")
        split = split.withColumnsRenamed({"cy": "sy", "cx": "sx"})
        # The other candidates of a target still bound it, and are bounded by it.
        rest = None
        for n, (at, have) in enumerate(done):
            marked = have.select("ty", "tx", *[f"t{b}" for b in _BOX], "sy", "sx", "sn", "sm", *[f"s{b}" for b in _BOX], F.lit(at).alias("_level"))
            rest = marked if rest is None else rest.unionByName(marked)
        every = cut(_kept(rest.unionByName(split.withColumn("_level", F.lit(level))), need, None if radius is None else radius * radius))
        crowded = (F.col("_level") == level) & (F.col("sm") > leaf)
        open_pairs = every.where(crowded).drop("_level")
        settled = every.where(~crowded)
        done = [(at, settled.where(F.col("_level") == at).drop("_level")) for at in dict.fromkeys([*(a for a, _ in done), level])]
    if level >= top + DEEPEST:
        done.append((level, open_pairs))

    out = None
    for at, have in done:
        side = 2.0 ** (top - at)
        wanted = have.select(F.col("ty").alias("_a"), F.col("tx").alias("_b"), F.struct("sy", "sx").alias("_k"))
        placed = sources.select("_y", "_x", F.struct(_key("_y", oy, side).alias("sy"), _key("_x", ox, side).alias("sx")).alias("_k"))
        found = wanted.join(placed, "_k").select("_a", "_b", "_y", "_x")
        out = found if out is None else out.unionByName(found)
    own = targets.select(F.col("_y").alias("_ty"), F.col("_x").alias("_tx"), _key("_y", oy, 1.0).alias("_a"), _key("_x", ox, 1.0).alias("_b"))
    return own.join(out, ["_a", "_b"]).select("_ty", "_tx", "_y", "_x")
