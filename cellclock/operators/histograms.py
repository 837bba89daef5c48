"""Histograms per band and label, and the reusable master histogram."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.functions.scaling import normalized, scale_clip, scale_maxabs_clip
from cellclock.names import HORIZONS, lag_name
from cellclock.operators.keyed import lookup
from cellclock.operators.ordered import rank_moments, rank_quantiles, value_ranks

MASTER_BINS = 50000  # fixed value

# Bins drawn per kind of band, for percentile and for full range.
CLIP_BINS = {"vegetation": 100, "elevation": 150, "band": 80}
FULL_BINS = {"vegetation": 100, "elevation": 150, "band": 200}

# Ranges of the master histogram per kind of band.
MASTER_RANGES = {"vegetation": (-1.0, 1.0), "elevation": (-3000.0, 3000.0), "band": (0.0, 1000.0)}


def pooled_windows(
    df: DataFrame,
    bands: Sequence[str],
    static: Sequence[str] = (),
    horizons: int = HORIZONS,
    label: str = "output_",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Value/label pairs of all sliding windows: window i holds lags [i-h, i) and
    label ``output_i``. Instead of one row per window and lag, each value comes
    once per label with the number of windows it stands in as ``weight``.
    """
    cells = []
    for band in bands:
        lags = [None] if band in static else range(-horizons, horizons - 1)
        for k in lags:
            inside = [i for i in range(horizons) if k is None or i - horizons <= k < i]
            name = band if k is None else lag_name(band, k)
            # All windows see a static value in each of their lags.
            times = horizons if k is None else 1
            for value in (0, 1):
                weight = " + ".join(f"CAST(`{label}{i}` <=> {value} AS int)" for i in inside)
                cells.append(
                    f"struct('{band}' AS band, {value} AS label, CAST(`{name}` AS double) AS value, "
                    f"CAST(({weight}) * {times} AS bigint) AS weight)"
                )
    return df.select(*keep, F.expr(f"inline(array({', '.join(cells)}))")).where("weight > 0")


def _with_bands(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Attach per-band numbers. Bands are column groups of a wide table, so the table
    has at most as many rows as that has columns and is always broadcast."""
    few = table.select(F.col("band").alias("_band"), *columns)
    return df.join(F.broadcast(few), F.col("band").eqNullSafe(F.col("_band"))).drop("_band")


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1)


def band_bins(bins: Mapping[str, int], default: int) -> Column:
    """Number of bins as a function of the band column."""
    if not bins:
        return F.lit(default)
    table = F.create_map(*[x for b, n in bins.items() for x in (F.lit(b), F.lit(n))])
    return F.coalesce(table[F.col("band")], F.lit(default))


def _count_bins(df: DataFrame, group: list[str], bin_index: Column, inside: Column | None = None) -> DataFrame:
    """Rows (group, bin, count, pct) of the values ``inside``; percent of all of ``df``.

    One aggregate counts both: what lies outside is a row of its own for each group, and
    totals are summed over a group's few bins."""
    inside = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    where = F.when(inside, bin_index.cast("int"))
    counts = df.groupBy(*group, inside.alias("_inside"), where.alias("bin")).agg(F.sum(_weight(df)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*group))
    return counts.withColumn("pct", F.col("count") * 100.0 / total).where("_inside").drop("_inside")


def histogram_by_label(
    pooled: DataFrame, frame: DataFrame, bins: Mapping[str, int] | None = None, default_bins: int = CLIP_BINS["band"]
) -> DataFrame:
    """bin = floor((x-lo)/(hi-lo)*(n-1)) of the values within [lo, hi]; percent of
    *all* values of the label. ``frame``: band, lo, hi."""
    base = _with_bands(pooled.where(F.col("value").isNotNull()), frame, "lo", "hi")
    n = band_bins(bins or {}, default_bins)
    where = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (n - 1))
    return _count_bins(base, ["band", "label"], where, F.col("value").between(F.col("lo"), F.col("hi")))


def histogram_clipped(
    pooled: DataFrame, scales: DataFrame, mode: str = "pct", bins: Mapping[str, int] | None = None, default_bins: int = CLIP_BINS["band"]
) -> DataFrame:
    """Clamp first, so that every value falls into a bin; percent of all rows.

    ``raw`` clamps to [p2, p98], ``pct`` scales that range to [0, 1], ``maxabs``
    scales by the largest magnitude to [-1, 1].
    """
    base = _with_bands(pooled.where(F.col("value").isNotNull()), scales, "p2", "p98", "max_abs")
    n = band_bins(bins or {}, default_bins)
    v, p2, p98 = F.col("value"), F.col("p2"), F.col("p98")
    if mode == "raw":
        x = F.greatest(p2, F.least(p98, v))
        where = F.floor((x - p2) / F.nullif(p98 - p2, F.lit(0.0)) * (n - 1))
    elif mode == "pct":
        where = F.floor(scale_clip(v, p2, p98) * (n - 1))
    elif mode == "maxabs":
        where = F.floor((scale_maxabs_clip(v, F.col("max_abs")) + 1) / 2 * (n - 1))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return _count_bins(base, ["band"], where)


def display_range(kind: str) -> tuple[float, float]:
    return (0.0, 1.0) if kind == "minmax" else (-1.0, 1.0)


def _by_kind(kinds: Mapping[str, str], make) -> Column:
    """CASE over the band's kind; the default kind is ``minmax``."""
    expr = make("minmax")
    for band, kind in kinds.items():
        expr = F.when(F.col("band") == band, make(kind)).otherwise(expr)
    return expr


def histogram_normalized(
    pooled: DataFrame,
    scales: DataFrame,
    kinds: Mapping[str, str],
    bins: Mapping[str, int] | None = None,
    default_bins: int = FULL_BINS["band"],
) -> DataFrame:
    """Histogram of the normalised value among raw values within [min, max];
    percent of the rows of the label that are in range."""
    base = _with_bands(pooled, scales, "min", "max")
    base = base.where(F.col("value").between(F.col("min"), F.col("max")))
    norm = _by_kind(kinds, lambda kind: normalized(F.col("value"), kind, F.col("min"), F.col("max")))
    lo = _by_kind(kinds, lambda kind: F.lit(display_range(kind)[0]))
    hi = _by_kind(kinds, lambda kind: F.lit(display_range(kind)[1]))
    n = band_bins(bins or {}, default_bins)
    return _count_bins(base, ["band", "label"], F.floor((norm - lo) / (hi - lo) * (n - 1)))


def master_histogram(pooled: DataFrame, ranges: DataFrame, bins: int = MASTER_BINS) -> DataFrame:
    """Counts over fixed half-open ranges, fine enough to serve any later scale.
    ``ranges``: band, lo, hi. One scan, one aggregate with at most
    bands x labels x bins groups."""
    base = _with_bands(pooled, ranges, "lo", "hi")
    base = base.where((F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi")))
    where = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
    return base.groupBy("band", "label", "lo", "hi", where.alias("bin")).agg(F.sum(_weight(base)).alias("count"))


def _centres(master: DataFrame, bins: int) -> DataFrame:
    width = (F.col("hi") - F.col("lo")) / bins
    return master.withColumn("_centre", F.col("lo") + (F.col("bin") + 0.5) * width)


def rebin_histogram(
    master: DataFrame,
    scales: DataFrame,
    bins: Mapping[str, int] | None = None,
    default_bins: int = FULL_BINS["band"],
    kinds: Mapping[str, str] | None = None,
    group_by: Sequence[str] = ("band",),
    master_bins: int = MASTER_BINS,
) -> DataFrame:
    """Map a master histogram to the bins of a train scale without rescanning.

    Bin centres outside [min, max] are left out, the index is clipped to the last
    bin, and percentages are of the whole master count of the group. With ``kinds``
    the centres are normalised first.
    """
    group = list(group_by)
    totals = master.groupBy(*group).agg(F.sum("count").alias("_total"))
    base = _with_bands(_centres(master, master_bins), scales, "min", "max")
    base = base.where((F.col("max") > F.col("min")) & F.col("_centre").between(F.col("min"), F.col("max")))
    n = band_bins(bins or {}, default_bins)
    if kinds is None:
        x, lo, hi = F.col("_centre"), F.col("min"), F.col("max")
    else:
        x = _by_kind(kinds, lambda kind: normalized(F.col("_centre"), kind, F.col("min"), F.col("max")))
        lo = _by_kind(kinds, lambda kind: F.lit(display_range(kind)[0]))
        hi = _by_kind(kinds, lambda kind: F.lit(display_range(kind)[1]))
    where = F.greatest(F.lit(0), F.least(n - 1, F.floor((x - lo) / (hi - lo) * n)))
    counts = base.groupBy(*group, where.cast("int").alias("bin")).agg(F.sum("count").alias("count"))
    out = lookup(counts, totals, group, "inner")
    return out.withColumn("pct", F.col("count") * 100.0 / F.col("_total")).drop("_total")


def stats_from_histogram(
    master: DataFrame, scales: DataFrame, group_by: Sequence[str] = ("band",), master_bins: int = MASTER_BINS
) -> DataFrame:
    """Lowest and highest non-empty centre within the scale, count-weighted mean,
    and the total count; zeros when the range holds nothing."""
    base = _with_bands(_centres(master, master_bins), scales, "min", "max")
    inside = F.col("_centre").between(F.col("min"), F.col("max")) & (F.col("count") > 0)
    hit = F.when(inside, F.col("_centre"))
    n = F.sum(F.when(inside, F.col("count")))
    return base.groupBy(*group_by).agg(
        F.sum("count").alias("total_rows"),
        F.coalesce(F.min(hit), F.lit(0.0)).alias("min_centre"),
        F.coalesce(F.max(hit), F.lit(0.0)).alias("max_centre"),
        F.coalesce(F.sum(hit * F.col("count")) / n, F.lit(0.0)).alias("mean"),
    )


def trimmed_density(df: DataFrame, value: str, bins: int = 100, group_by: Sequence[str] = ()) -> DataFrame:
    """Density histogram between the 0.5 and 99.5 percentiles (last bin closed), from one
    scan of ``df``; NULL and NaN are left out."""
    ranks, group = value_ranks(df, value, group_by)
    bounds = rank_quantiles(ranks, group, {"lo": 0.005, "hi": 0.995})
    inside = lookup(ranks, bounds, group, "inner").where(F.col("_v").between(F.col("lo"), F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    where = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))).cast("int")
    counts = inside.groupBy(*group, "lo", "hi", where.alias("bin")).agg(F.sum("_c").alias("count"))
    totals = counts.groupBy(*group).agg(F.sum("count").alias("_total"))
    out = lookup(counts, totals, group, "inner")
    out = out.withColumn("density", F.col("count") / (F.col("_total") * F.nullif(width, F.lit(0.0)))).drop("_total")
    return out.drop("_all") if not group_by else out


def _density_ends(points: int, threshold: float):
    """One row per group: where the binned Gaussian density rises above a fraction
    of its peak, NULL at the ends of the evaluated range."""

    @F.pandas_udf("x_left double, x_right double")
    def ends(x: pd.Series, c: pd.Series, lo: pd.Series, hi: pd.Series, h: pd.Series) -> pd.DataFrame:
        found = []
        for xs, cs, a, b, width in zip(x, c, lo, hi, h):
            at = a + (b - a) * np.arange(points) / (points - 1)
            density = np.exp(-((at[:, None] - xs[None, :]) ** 2) / (2 * width * width)) @ np.asarray(cs, float)
            above = np.flatnonzero(density > threshold * density.max())
            first, last = above[0], above[-1]
            found.append((at[first] if first > 0 else None, at[last] if last < points - 1 else None))
        return pd.DataFrame(found, columns=["x_left", "x_right"], dtype=float)

    return ends


def kde_bounds(
    df: DataFrame,
    value: str,
    group_by: Sequence[str] = (),
    bins: int = 2048,
    points: int = 1024,
    threshold: float = 0.015,
) -> DataFrame:
    """Where a Gaussian KDE (Scott bandwidth, std * n^(-1/5)) on ``points`` places
    between the 0.5 and 99.5 percentiles first and last exceeds ``threshold`` of
    its peak; NULL when that is the end of the range, or when a group has no spread.

    ``df`` is scanned once. Its values are reduced to ``bins`` counts over its full range, at bin means,
    so the kernel sums take at most bins x points steps per group, whatever the
    number of rows.
    """
    ranks, group = value_ranks(df, value, group_by)
    v = F.col("_v")
    found = rank_moments()
    also = {"_n": found["count"], "_s": found["std"], "_min": found["min"], "_max": found["max"]}
    bounds = rank_quantiles(ranks, group, {"lo": 0.005, "hi": 0.995}, also)
    width = (F.col("_max") - F.col("_min")) / bins
    where = F.least(F.lit(bins - 1), F.floor((v - F.col("_min")) / width)).cast("int")
    spread = bounds.where("_s > 0").select(*group, "_min", "_max")
    binned = lookup(ranks, spread, group, "inner").groupBy(*group, where.alias("_bin")).agg(
        F.sum("_c").alias("_k"), (F.sum(v * F.col("_c")) / F.sum("_c")).alias("_x")
    )
    # A group's bins are one short array (at most ``bins`` entries).
    packed = binned.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_x", F.col("_k").alias("_c")))).alias("_bins"))
    h = F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))
    ends = _density_ends(points, threshold)
    density = lookup(bounds.where("hi > lo"), packed, group, "inner").select(
        *group, ends(F.col("_bins._x"), F.col("_bins._c"), "lo", "hi", h).alias("_ends")
    )
    # A group of one row or of equal values has no density, hence no bounds.
    out = lookup(bounds.select(*group), density.select(*group, "_ends.x_left", "_ends.x_right"), group)
    return out.drop("_all") if not group_by else out
