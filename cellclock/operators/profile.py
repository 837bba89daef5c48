"""Descriptive statistics, audits and drift reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.functions.clock import floor_clock, from_epoch_minutes, epoch_minutes
from cellclock.functions.special import pearson
from cellclock.names import FULL, HORIZONS, lag_name, q
from cellclock.operators.keyed import lookup
from cellclock.operators.ordered import quantiles, rank_moments, rank_quantiles, value_ranks


def pool_lags(
    df: DataFrame, bands: Sequence[str], offsets: Sequence[int] = FULL, static: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Long ``(keep…, band, lag, value)`` of all lags that exist; one scan."""
    have = set(df.columns)
    cells = []
    for band in bands:
        for k in [None] if band in static else offsets:
            name = band if k is None else lag_name(band, k)
            if name in have:
                lag = "CAST(NULL AS int)" if k is None else k
                cells.append(f"struct('{band}' AS band, {lag} AS lag, CAST(`{name}` AS double) AS value)")
    return df.select(*keep, F.expr(f"inline(array({', '.join(cells)}))"))


def valid(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _moments(value: Column) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, value: str = "value", group_by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear, exact) and max per group."""
    clean = df.where(valid(q(value).cast("double")))
    group = list(group_by) or ["_all"]
    if not group_by:
        clean = clean.withColumn("_all", F.lit(0))
    stats = clean.groupBy(*group).agg(*_moments(q(value)))
    out = lookup(stats, quantiles(clean, value, QUARTILES, group), group, "inner")
    return out.select(*group_by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`describe` of several columns at once, as rows ``feature, …``."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias("value")) for c in columns])
        ).alias("_c")
    ).select("_c.*")
    return describe(long, "value", ["feature"])


def shape_stats(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    v = q(value)
    raw = df.where(valid(v.cast("double"))).groupBy(*group_by).agg(
        F.count(v).cast("double").alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return raw.select(*group_by, F.col("n").cast("long").alias("n"), skew.alias("skewness"), kurt.alias("kurtosis"))


BAND_QUANTILES = {"p2": 0.02, "median": 0.5, "p98": 0.98}


def band_stats(
    pooled: DataFrame,
    group_by: Sequence[str] = ("band",),
    weight: str | None = None,
    exact: bool = True,
    accuracy: int = 10000,
) -> DataFrame:
    """count, min, max, mean, median, p2, p98 and max|x| of ``value`` per group.

    ``exact=False`` uses the mergeable quantile sketch in the same aggregate: one
    pass, rank error 1/accuracy. The exact form scans ``pooled`` once as well and takes
    all from the counted values. ``weight`` counts a row several times, or not at all,
    and needs the exact form.
    """
    names = ["count", "min", "max", "mean", "max_abs"]
    if exact:
        also = {n: c for n, c in rank_moments().items() if n in names} | {"max_abs": F.max(F.abs("_v"))}
        out = quantiles(pooled, "value", BAND_QUANTILES, group_by, weight, also)
    else:
        if weight:
            raise ValueError("the quantile sketch takes no weights; use exact=True")
        v = F.col("value")
        out = pooled.where(valid(v)).groupBy(*group_by).agg(
            F.count(v).alias("count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.max(F.abs(v)).alias("max_abs"),
            F.percentile_approx(v, list(BAND_QUANTILES.values()), accuracy).alias("_q"),
        )
        out = out.withColumns({n: F.col("_q")[i] for i, n in enumerate(BAND_QUANTILES)})
    return out.select(*group_by, "count", "min", "max", "mean", "median", "p2", "p98", "max_abs")


def maxabs_stats(pooled: DataFrame, group_by: Sequence[str] = ("band",)) -> DataFrame:
    return band_stats(pooled, group_by)


SCALED = ("min", "max", "p2", "p98", "mean", "median")


def fit_scales(stats: DataFrame, maxabs_bands: Sequence[str] = ()) -> DataFrame:
    """Statistics plus the same numbers on the fitted scale: (x-p2)/(p98-p2), or
    x/max|x| for the bands listed."""
    by_max = F.col("band").isin(*maxabs_bands) if maxabs_bands else F.lit(False)
    width = F.nullif(F.col("p98") - F.col("p2"), F.lit(0.0))
    top = F.nullif(F.col("max_abs"), F.lit(0.0))
    scaled = {
        f"scaled_{c}": F.when(by_max, F.col(c) / top).otherwise(F.coalesce((F.col(c) - F.col("p2")) / width, F.lit(0.0)))
        for c in SCALED
    }
    return stats.withColumns(scaled)


def combined_frame(stats_by_label: DataFrame) -> DataFrame:
    """One frame for both labels: the lowest p2 and the highest p98."""
    return stats_by_label.groupBy("band").agg(F.min("p2").alias("p2"), F.max("p98").alias("p98"))


def drift_report(train: DataFrame, other: DataFrame) -> DataFrame:
    """Statistics of another set on the train scale, before any clipping."""
    ref = train.select("band", F.col("p2").alias("train_p2"), F.col("p98").alias("train_p98"))
    width = F.nullif(F.col("train_p98") - F.col("train_p2"), F.lit(0.0))
    joined = other.join(ref, "band")
    return joined.select(
        "band", "count", "train_p2", "train_p98", *SCALED,
        *[F.coalesce((F.col(c) - F.col("train_p2")) / width, F.lit(0.0)).alias(f"scaled_{c}") for c in SCALED],
    )


def range_violations(pooled: DataFrame, scales: DataFrame) -> DataFrame:
    """Actual against stored bounds per band, and how much is missing or outside.

    ``scales`` has a row for each band, so it is sent to all tasks: in a shuffle by band
    a task would hold all values of one."""
    v = F.col("value")
    bounds = scales.select("band", F.col("min").alias("info_min"), F.col("max").alias("info_max"))
    joined = pooled.join(F.broadcast(bounds), "band")
    outside = (v < F.col("info_min")) | (v > F.col("info_max"))
    return joined.groupBy("band", "info_min", "info_max").agg(
        F.min(F.when(valid(v), v)).alias("actual_min"),
        F.max(F.when(valid(v), v)).alias("actual_max"),
        F.sum((~valid(v)).cast("int")).alias("missing"),
        F.sum(F.when(valid(v) & outside, 1).otherwise(0)).alias("outside"),
    )


def box_stats(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends and the number of outliers."""
    ranks, group = value_ranks(df, value, group_by)
    box = rank_quantiles(ranks, group, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    box = box.withColumns({"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr})
    # The fences meet the stored distinct values, not the rows.
    inside = F.col("_v").between(F.col("low_fence"), F.col("high_fence"))
    names = ["q1", "median", "q3", "low_fence", "high_fence"]
    out = lookup(ranks, box, group, "inner").groupBy(*group, *names).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"),
    )
    return out.drop("_all") if not group_by else out


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both are present, as
    ``feature_a, feature_b, corr`` (upper triangle). One aggregate, one pass."""
    clean = [F.when(valid(q(c).cast("double")), q(c).cast("double")) for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[pearson(clean[i], clean[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"), F.col(f"c{i}_{j}").alias("corr")
        )
        for i, j in pairs
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def class_balance(df: DataFrame, horizons: int = HORIZONS, prefix: str = "output_") -> DataFrame:
    """0/1 counts per horizon."""
    row = df.agg(
        *[F.sum(F.when(q(f"{prefix}{i}") == v, 1).otherwise(0)).alias(f"n{v}_{i}") for i in range(horizons) for v in (0, 1)]
    )
    cells = [
        F.struct(F.lit(i).alias("horizon"), F.col(f"n0_{i}").alias("negatives"), F.col(f"n1_{i}").alias("positives"))
        for i in range(horizons)
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column; columns without any are left out."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        test = q(c).isNull()
        return test | F.isnan(q(c)) if types[c] in ("double", "float") else test

    row = df.agg(*[F.sum(missing(c).cast("int")).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("missing > 0")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def dedup_report(df: DataFrame) -> DataFrame:
    """Rows before and after dropping exact duplicates."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("before"), F.count(F.lit(1)).alias("after"))


def slots_per_year(slots: DataFrame, ts: str = "ts") -> DataFrame:
    return slots.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("slots"))


def missing_scene_report(
    errors: DataFrame, columns: Mapping[str, tuple[str, int]], marker: str = "File error", ts: str = "ts"
) -> DataFrame:
    """Wide error cells to distinct (scene time, band). ``columns`` maps a column
    to its band and the minutes it lies back."""
    cells = [
        F.struct(F.lit(b).alias("band"), F.lit(m).alias("back"), q(c).cast("string").alias("cell"))
        for c, (b, m) in columns.items()
    ]
    hits = errors.select(ts, F.explode(F.array(*cells)).alias("_c")).where(F.col("_c.cell") == marker)
    at = from_epoch_minutes(epoch_minutes(floor_clock(ts)) - F.col("_c.back"))
    return hits.select(at.alias("ts"), F.col("_c.band").alias("band")).distinct()


def times_by_band(index: DataFrame) -> DataFrame:
    """Distinct scene times, by band and ascending."""
    return index.select("band", "ts").distinct().orderBy("band", "ts")


def feature_rank_sum(ranking: DataFrame, skip_first: bool = True) -> DataFrame:
    """Positions of a band's lags in a ranking, summed per band. ``skip_first``
    leaves out the first (best) lag of a band. ``ranking``: feature, position."""
    band = F.regexp_replace("feature", r"(\(\d+\)|_t[+-]\d+|_\d+p)$", "")
    total = F.sum("position")
    if skip_first:
        total = total - F.min("position")
    return ranking.groupBy(band.alias("feature")).agg(total.alias("rank"))
