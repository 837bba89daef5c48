"""Profiling queries on the fixture views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cellclock.functions import cleaning
from cellclock.names import FULL, HISTORY, HORIZONS, lag_columns, lag_name, q
from cellclock.operators import histograms as hist
from cellclock.operators import lookups, ordered, profile
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query


def rounded(df, digits=6, keep=()):
    """Floating-point results of long sums are compared after rounding."""
    types = dict(df.dtypes)
    return df.select(
        *[F.round(q(c), digits).alias(c) if types[c] in ("double", "float") and c not in keep else q(c) for c in df.columns]
    )


def pooled_sql(bands, offsets=FULL, view="samples", static=()):
    parts = [
        f"SELECT '{b}' AS band, " + (f'"{b}"' if b in static else f'"{lag_name(b, k)}"') + f"::DOUBLE AS value FROM {view}"
        for b in bands
        for k in ([0] if b in static else offsets)
    ]
    return " UNION ALL ".join(parts)


def windows_sql(bands, static=()):
    """The plain form: one branch per window and lag."""
    parts = [
        f"SELECT '{b}' AS band, " + (f'"{b}"' if b in static else f'"{lag_name(b, k)}"')
        + f"::DOUBLE AS value, output_{i} AS label FROM samples"
        for b in bands
        for i in range(HORIZONS)
        for k in range(i - HORIZONS, i)
    ]
    return " UNION ALL ".join(parts)


def samples(spark, sf_dir):
    return fx.samples(spark, sf_dir)


def pool(spark, sf_dir, bands=("V", "K"), static=()):
    return profile.pool_lags(samples(spark, sf_dir), bands, FULL, static)


def windows(spark, sf_dir, bands=("V", "K"), static=()):
    return hist.pooled_windows(samples(spark, sf_dir), bands, static)


# ---- duplicates, counts, audits ---------------------------------------------

_DIRTY = ["sid", "V_t-1", "K_t-1"]


@query("dedup_rows", views="dirty", oracle='SELECT DISTINCT sid, "V_t-1", "K_t-1" FROM dirty')
def dedup_rows(spark, sf_dir):
    return cleaning.drop_duplicates(fx.dirty_samples(spark, sf_dir).select(*[q(c) for c in _DIRTY]))


@query("dedup_report", views="dirty",
       oracle="SELECT count(*) AS before, count(DISTINCT sid) AS after FROM dirty")
def dedup_report(spark, sf_dir):
    return profile.dedup_report(fx.dirty_samples(spark, sf_dir).select(*[q(c) for c in _DIRTY]))


@query("value_counts", views="strikes",
       oracle="SELECT minute(t10) AS minute, kind, count(*) AS count FROM strikes GROUP BY ALL")
def value_counts(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select(F.minute("t10").alias("minute"), "kind")
    return profile.value_counts(s, "minute", "kind")


@query("distinct_values", views="strikes", oracle="SELECT DISTINCT strftime(t10, '%Y-%m-%d-%H-%M') AS t FROM strikes")
def distinct_values(spark, sf_dir):
    from cellclock.functions.clock import format_slot

    return profile.distinct_values(fx.strikes(spark, sf_dir).select(format_slot("t10").alias("t")), "t")


@query("class_balance", views="samples",
       oracle=" UNION ALL ".join(
           f"SELECT {i} AS horizon, count(*) FILTER (output_{i} = 0) AS negatives, count(*) FILTER (output_{i} = 1) AS positives FROM samples"
           for i in range(HORIZONS)))
def class_balance(spark, sf_dir):
    return profile.class_balance(samples(spark, sf_dir))


@query("null_audit", views="dirty",
       oracle="SELECT * FROM (" + " UNION ALL ".join(
           f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL OR isnan("{c}")) AS missing FROM dirty"""
           for c in lag_columns(["V", "K"], FULL)) + ") WHERE missing > 0")
def null_audit(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir)
    return profile.null_audit(d, ["sid", *lag_columns(["V", "K"], FULL)])


@query(
    "slots_per_year",
    views="strikes",
    oracle="""WITH y AS (SELECT min(year(ts)) - 4 AS a, max(year(ts)) AS b FROM strikes)
      SELECT year(t) AS year, count(*) AS slots FROM (SELECT unnest(generate_series(make_timestamp(a, 1, 1, 0, 0, 0.0),
        make_timestamp(b, 12, 31, 23, 50, 0.0), INTERVAL 10 MINUTE)) AS t FROM y) GROUP BY 1""",
)
def slots_per_year(spark, sf_dir):
    # the years come from the data, four back to its last
    years = fx.strikes(spark, sf_dir).agg((F.min(F.year("ts")) - 4).alias("a"), F.max(F.year("ts")).alias("b"))
    year = years.select(F.explode(F.sequence("a", "b")).alias("y"))
    slot = F.explode(
        F.sequence(
            F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
            F.make_timestamp_ntz("y", F.lit(12), F.lit(31), F.lit(23), F.lit(50), F.lit(0)),
            F.expr("INTERVAL 10 MINUTES"),
        )
    )
    return profile.slots_per_year(year.select(slot.alias("ts")))


_ERR = {"click_10p": ("click", 10), "click_20p": ("click", 20), "view_10p": ("view", 10)}


@query(
    "missing_scene_report",
    views="strikes px10",
    oracle="""WITH h AS (SELECT DISTINCT ts, band FROM px10), r(band, back) AS (VALUES ('click', 10), ('click', 20), ('view', 10))
      SELECT DISTINCT CAST(time_bucket(INTERVAL 10 MINUTE, s.ts) - r.back * INTERVAL 1 MINUTE AS TIMESTAMP) AS ts, r.band AS band
      FROM strikes s, r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.band = r.band
        AND h.ts = s.t10 - r.back * INTERVAL 1 MINUTE)""",
)
def missing_scene_report(spark, sf_dir):
    """Strikes with a "File error" cell wherever no scene exists for the band."""
    s = fx.strikes(spark, sf_dir).select("event_id", "ts", "t10")
    scenes = fx.px10(spark, sf_dir).groupBy("ts").agg(F.collect_set("band").alias("have"))  # at most five bands
    lagged = s.select("*", F.explode(F.array(F.lit(10), F.lit(20))).alias("back"))
    at = (F.col("t10") - F.make_dt_interval(mins=F.col("back"))).alias("at")
    seen = lagged.select("*", at).join(scenes.withColumnRenamed("ts", "at"), "at", "left")

    def cell(band, back):
        hit = F.coalesce(F.array_contains("have", band), F.lit(False))
        return F.max(F.when((F.col("back") == back) & ~hit, "File error"))

    wide = seen.groupBy("event_id", "ts").agg(*[cell(b, m).alias(c) for c, (b, m) in _ERR.items()])
    return profile.missing_scene_report(wide, _ERR)


@query("times_by_band", views="strikes px10", oracle="SELECT DISTINCT band, ts FROM px10 ORDER BY band, ts")
def times_by_band(spark, sf_dir):
    return profile.times_by_band(fx.px10(spark, sf_dir))


# ---- descriptive statistics -------------------------------------------------


def _describe_sql(source, group=""):
    g = f"{group}, " if group else ""
    return f"""SELECT {g}count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
      quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max
      FROM ({source}) WHERE value IS NOT NULL {f'GROUP BY {group}' if group else ''}"""


@query("describe", oracle="SELECT round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, * EXCLUDE (p25, p50, p75) FROM ("
       + _describe_sql("SELECT value FROM events") + ")")
def describe(spark, sf_dir):
    return rounded(profile.describe(fx.table(spark, sf_dir, "events"), "value"))


@query("describe_columns", oracle="SELECT round(min, 6) AS min, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(max, 6) AS max, * EXCLUDE (min, p25, p50, p75, max) FROM ("
       + _describe_sql("""SELECT 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL
         SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem""", "feature") + ")")
def describe_columns(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return rounded(profile.describe_columns(li, ["l_quantity", "l_extendedprice", "l_tax"]))


@query("describe_band", views="samples",
       oracle="SELECT round(min, 6) AS min, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(max, 6) AS max, * EXCLUDE (min, p25, p50, p75, max) FROM ("
       + _describe_sql(pooled_sql(("V", "K")), "band") + ")")
def describe_band(spark, sf_dir):
    return rounded(profile.describe(pool(spark, sf_dir), "value", ["band"]))


@query("shape_stats",
       oracle="SELECT event_type, count(value) AS n, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events GROUP BY event_type")
def shape_stats(spark, sf_dir):
    return rounded(profile.shape_stats(fx.table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("exact_quantiles",
       oracle="""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.7), 6) AS p70, round(quantile_cont(l_extendedprice, 0.8), 6) AS p80,
         round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    probs = {"p70": 0.7, "p80": 0.8, "p90": 0.9, "p999": 0.999}
    return rounded(ordered.quantiles(li, "l_extendedprice", probs, ["l_returnflag"]))


_STATS = """count(value) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.02), 6) AS p2,
  round(quantile_cont(value, 0.98), 6) AS p98, round(max(abs(value)), 6) AS max_abs"""
_RAW_STATS = """count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.98) AS p98, max(abs(value)) AS max_abs"""


@query("band_stats", views="samples", oracle=f"SELECT band, {_STATS} FROM ({pooled_sql(('V', 'K'))}) WHERE value IS NOT NULL GROUP BY band")
def band_stats(spark, sf_dir):
    return rounded(profile.band_stats(pool(spark, sf_dir)))


@query("band_stats_approx", views="samples",
       oracle=f"""SELECT band, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, true AS close
         FROM ({pooled_sql(('V', 'K'))}) WHERE value IS NOT NULL GROUP BY band""")
def band_stats_approx(spark, sf_dir):
    """One-pass form; the sketch must agree with the exact quantiles to the rank error."""
    pooled = pool(spark, sf_dir)
    approx = profile.band_stats(pooled, exact=False)
    probs = {f"{n}_{s}": p + d for n, p in profile.BAND_QUANTILES.items() for s, d in (("lo", -0.002), ("hi", 0.002))}
    exact = ordered.quantiles(pooled, "value", probs, ["band"])
    close = [F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")) for n in profile.BAND_QUANTILES]
    out = approx.join(exact, "band")
    return out.select("band", "count", "min", "max", F.round("mean", 6).alias("mean"), reduce(lambda a, b: a & b, close).alias("close"))


@query("band_stats_by_label", views="samples",
       oracle=f"SELECT band, label, {_STATS} FROM ({windows_sql(('V', 'K'))}) WHERE value IS NOT NULL GROUP BY band, label")
def band_stats_by_label(spark, sf_dir):
    return rounded(profile.band_stats(windows(spark, sf_dir), ["band", "label"], "weight"))


@query("maxabs_stats", views="samples",
       oracle=f"SELECT band, {_STATS} FROM ({pooled_sql(('V', 'Dem_value'), static=('Dem_value',))}) WHERE value IS NOT NULL GROUP BY band")
def maxabs_stats(spark, sf_dir):
    return rounded(profile.maxabs_stats(pool(spark, sf_dir, ("V", "Dem_value"), ("Dem_value",))))


@query("fit_scales", views="samples",
       oracle=f"""WITH st AS (SELECT band, {_RAW_STATS} FROM ({pooled_sql(('V', 'Dem_value'), static=('Dem_value',))}) WHERE value IS NOT NULL GROUP BY band)
         SELECT band, count, {", ".join(f"round({c}, 6) AS {c}" for c in ("min", "max", "mean", "median", "p2", "p98", "max_abs"))},
         {", ".join(f"round(CASE WHEN band = 'Dem_value' THEN {c} / max_abs ELSE ({c} - p2) / (p98 - p2) END, 6) AS scaled_{c}" for c in profile.SCALED)} FROM st""")
def fit_scales(spark, sf_dir):
    stats = profile.band_stats(pool(spark, sf_dir, ("V", "Dem_value"), ("Dem_value",)))
    return rounded(profile.fit_scales(stats, ["Dem_value"]))


_LABEL_STATS = f"SELECT band, label, {_RAW_STATS} FROM ({windows_sql(('V', 'K'))}) WHERE value IS NOT NULL GROUP BY band, label"


@query("combined_frame", views="samples",
       oracle=f"SELECT band, round(min(p2), 6) AS p2, round(max(p98), 6) AS p98 FROM ({_LABEL_STATS}) GROUP BY band")
def combined_frame(spark, sf_dir):
    return rounded(profile.combined_frame(profile.band_stats(windows(spark, sf_dir), ["band", "label"], "weight")))


def _half(df, parity):
    return df.where(F.col("sid") % 2 == parity)


@query("drift_report", views="samples",
       oracle=f"""WITH a AS (SELECT * FROM samples WHERE sid % 2 = 0), b AS (SELECT * FROM samples WHERE sid % 2 = 1),
         tr AS (SELECT band, {_RAW_STATS} FROM ({pooled_sql(('V', 'K'), view='a')}) WHERE value IS NOT NULL GROUP BY band),
         va AS (SELECT band, {_RAW_STATS} FROM ({pooled_sql(('V', 'K'), view='b')}) WHERE value IS NOT NULL GROUP BY band)
         SELECT va.band AS band, va.count AS count, round(tr.p2, 6) AS train_p2, round(tr.p98, 6) AS train_p98,
         {", ".join(f"round(va.{c}, 6) AS {c}, round((va.{c} - tr.p2) / (tr.p98 - tr.p2), 6) AS scaled_{c}" for c in profile.SCALED)}
         FROM va JOIN tr USING (band)""".replace("WITH a AS", "WITH a AS", 1))
def drift_report(spark, sf_dir):
    s = samples(spark, sf_dir)
    train = profile.band_stats(profile.pool_lags(_half(s, 0), ["V", "K"]))
    other = profile.band_stats(profile.pool_lags(_half(s, 1), ["V", "K"]))
    return rounded(profile.drift_report(train, other))


@query("range_violations", views="dirty",
       oracle=f"""WITH i(band, lo, hi) AS (VALUES ('V', 1.0::DOUBLE, 100.0::DOUBLE), ('K', 0.0::DOUBLE, 99.0::DOUBLE)),
         p AS ({pooled_sql(('V', 'K'), view='dirty')})
         SELECT i.band AS band, lo AS info_min, hi AS info_max, min(value) FILTER (NOT isnan(value)) AS actual_min, max(value) FILTER (NOT isnan(value)) AS actual_max,
         count(*) FILTER (value IS NULL OR isnan(value)) AS missing, count(*) FILTER (NOT isnan(value) AND (value < lo OR value > hi)) AS outside
         FROM p JOIN i USING (band) GROUP BY i.band, lo, hi""")
def range_violations(spark, sf_dir):
    scales = spark.createDataFrame([("V", 1.0, 100.0), ("K", 0.0, 99.0)], "band string, min double, max double")
    return profile.range_violations(profile.pool_lags(fx.dirty_samples(spark, sf_dir), ["V", "K"]), scales)


@query("box_stats",
       oracle="""WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
         f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM b)
         SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low_fence, 6) AS low_fence, round(high_fence, 6) AS high_fence,
         min(value) FILTER (value BETWEEN low_fence AND high_fence) AS whisker_low, max(value) FILTER (value BETWEEN low_fence AND high_fence) AS whisker_high,
         count(*) FILTER (value NOT BETWEEN low_fence AND high_fence) AS outliers
         FROM events JOIN f USING (event_type) GROUP BY event_type, q1, median, q3, low_fence, high_fence""")
def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(fx.table(spark, sf_dir, "events"), "value", ["event_type"]))


_CORR = ["V_t-2", "V_t-1", "K_t-1", "Dem_value"]


@query("correlation_matrix", views="samples",
       oracle=" UNION ALL ".join(
           f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN isfinite(corr("{a}", "{b}")) THEN round(corr("{a}", "{b}"), 6) END AS corr FROM samples"""
           for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(samples(spark, sf_dir), _CORR))


@query("feature_rank_sum", views="samples",
       oracle="WITH s AS (" + " UNION ALL ".join(
           f"""SELECT '{c}' AS f, abs(corr("{c}", output_0)) AS s FROM samples""" for c in lag_columns(["V", "K"], HISTORY))
       + """), r AS (SELECT f, row_number() OVER (ORDER BY round(s, 9) DESC, f) - 1 AS position FROM s)
         SELECT split_part(f, '_t', 1) AS feature, CAST(sum(position) - min(position) AS BIGINT) AS rank FROM r GROUP BY 1""")
def feature_rank_sum(spark, sf_dir):
    return profile.feature_rank_sum(_ranking(spark, sf_dir))


def _ranking(spark, sf_dir):
    """Lags of two bands by correlation with the label; a dozen rows."""
    from pyspark.sql import Window

    from cellclock.functions.special import pearson

    cols = lag_columns(["V", "K"], HISTORY)
    row = samples(spark, sf_dir).agg(*[F.abs(pearson(q(c), q("output_0"))).alias(f"s{i}") for i, c in enumerate(cols)])
    long = row.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(f"s{i}", 9).alias("s")) for i, c in enumerate(cols)])).alias("c")
    ).select("c.*")
    return long.select("feature", (F.row_number().over(Window.orderBy(F.desc("s"), "feature")) - 1).alias("position"))


# ---- histograms -------------------------------------------------------------


@query("pooled_windows", views="samples",
       oracle=f"SELECT band, label, value, count(*) AS weight FROM ({windows_sql(('V', 'Dem_value'), ('Dem_value',))}) GROUP BY ALL")
def pooled_windows(spark, sf_dir):
    w = windows(spark, sf_dir, ("V", "Dem_value"), ("Dem_value",))
    return w.groupBy("band", "label", "value").agg(F.sum("weight").alias("weight"))


_FRAMES = [("V", 2.0, 60.0), ("K", 10.0, 90.0)]
_FRAME_SQL = "f(band, lo, hi) AS (VALUES ('V', 2.0::DOUBLE, 60.0::DOUBLE), ('K', 10.0::DOUBLE, 90.0::DOUBLE))"


def _frames(spark, names="band string, lo double, hi double"):
    return spark.createDataFrame(_FRAMES, names)


@query("histogram_by_label", views="samples",
       oracle=f"""WITH {_FRAME_SQL}, w AS (SELECT * FROM ({windows_sql(('V', 'K'))}) WHERE value IS NOT NULL),
         t AS (SELECT band, label, count(*) AS total FROM w GROUP BY ALL)
         SELECT w.band AS band, w.label AS label, CAST(floor((value - lo) / (hi - lo) * (CASE WHEN w.band = 'K' THEN 99 ELSE 79 END)) AS INT) AS bin, count(*) AS count,
           round(count(*) * 100.0::DOUBLE / any_value(total), 6) AS pct FROM w JOIN f USING (band) JOIN t USING (band, label) WHERE value BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def histogram_by_label(spark, sf_dir):
    return rounded(hist.histogram_by_label(windows(spark, sf_dir), _frames(spark), {"K": 100}))


_SCALE_ROWS = [("V", 2.0, 60.0, 200.0), ("K", 10.0, 90.0, 99.0)]
_CLIP_SQL = "f(band, p2, p98, m) AS (VALUES ('V', 2.0::DOUBLE, 60.0::DOUBLE, 200.0::DOUBLE), ('K', 10.0::DOUBLE, 90.0::DOUBLE, 99.0::DOUBLE))"
_CLIP_BIN = {
    "raw": "(greatest(p2, least(p98, value)) - p2) / (p98 - p2)",
    "pct": "greatest(0.0, least(1.0, (value - p2) / (p98 - p2)))",
    "maxabs": "(greatest(-1.0, least(1.0, value / m)) + 1) / 2",
}
for _mode, _expr in _CLIP_BIN.items():

    def _clipped(spark, sf_dir, mode=_mode):
        scales = spark.createDataFrame(_SCALE_ROWS, "band string, p2 double, p98 double, max_abs double")
        return rounded(hist.histogram_clipped(pool(spark, sf_dir), scales, mode))

    query(
        "histogram_clipped" if _mode == "pct" else f"histogram_clipped_{_mode}",
        views="samples",
        oracle=f"""WITH {_CLIP_SQL}, w AS (SELECT * FROM ({pooled_sql(('V', 'K'))}) WHERE value IS NOT NULL),
         t AS (SELECT band, count(*) AS total FROM w GROUP BY ALL)
         SELECT w.band AS band, CAST(floor({_expr} * 79) AS INT) AS bin, count(*) AS count, round(count(*) * 100.0::DOUBLE / any_value(total), 6) AS pct
         FROM w JOIN f USING (band) JOIN t USING (band) GROUP BY 1, 2""",
    )(_clipped)


_NORM_KINDS = {"K": "max", "Dem_value": "maxabs"}
_NORM_ROWS = [("V", 0.5, 120.0), ("K", 0.0, 99.0), ("Dem_value", -4.0, 6.0)]
_NORM_SQL = "f(band, lo, hi) AS (VALUES ('V', 0.5::DOUBLE, 120.0::DOUBLE), ('K', 0.0::DOUBLE, 99.0::DOUBLE), ('Dem_value', -4.0::DOUBLE, 6.0::DOUBLE))"


def _norm_scales(spark):
    return spark.createDataFrame(_NORM_ROWS, "band string, min double, max double")


@query("histogram_normalized", views="samples",
       oracle=f"""WITH {_NORM_SQL}, w AS (SELECT *, CASE band WHEN 'V' THEN (value - lo) / (hi - lo) WHEN 'K' THEN value / hi ELSE value / 6.0::DOUBLE END AS norm
           FROM ({windows_sql(('V', 'K', 'Dem_value'), ('Dem_value',))}) JOIN f USING (band) WHERE value BETWEEN lo AND hi),
         t AS (SELECT band, label, count(*) AS total FROM w GROUP BY ALL)
         SELECT band, label, CAST(floor(CASE WHEN band = 'V' THEN norm * 199 ELSE (norm + 1) / 2 * (CASE WHEN band = 'K' THEN 199 ELSE 149 END) END) AS INT) AS bin,
           count(*) AS count, round(count(*) * 100.0::DOUBLE / any_value(total), 6) AS pct FROM w JOIN t USING (band, label) GROUP BY 1, 2, 3""")
def histogram_normalized(spark, sf_dir):
    w = windows(spark, sf_dir, ("V", "K", "Dem_value"), ("Dem_value",))
    return rounded(hist.histogram_normalized(w, _norm_scales(spark), _NORM_KINDS, {"Dem_value": 150}))


_RANGE_ROWS = [("V", 0.0, 1000.0), ("K", 0.0, 1000.0), ("Dem_value", -3000.0, 3000.0)]
_MASTER_SQL = f"""r(band, lo, hi) AS (VALUES ('V', 0.0::DOUBLE, 1000.0::DOUBLE), ('K', 0.0::DOUBLE, 1000.0::DOUBLE), ('Dem_value', -3000.0::DOUBLE, 3000.0::DOUBLE)),
  w AS (SELECT * FROM ({windows_sql(('V', 'K', 'Dem_value'), ('Dem_value',))})),
  m AS (SELECT w.band AS band, label, lo, hi, CAST(floor((value - lo) / (hi - lo) * 50000) AS INT) AS bin, count(*) AS count
    FROM w JOIN r USING (band) WHERE value >= lo AND value < hi GROUP BY 1, 2, 3, 4, 5)"""
_CENTRE_SQL = f"WITH {_MASTER_SQL}, {_NORM_SQL.replace('f(band, lo, hi)', 'f(band, a, b)')}, c AS (SELECT *, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 50000) AS v FROM m JOIN f USING (band))"


def _master(spark, sf_dir):
    ranges = spark.createDataFrame(_RANGE_ROWS, "band string, lo double, hi double")
    return hist.master_histogram(windows(spark, sf_dir, ("V", "K", "Dem_value"), ("Dem_value",)), ranges)


@query("master_histogram", views="samples", oracle=f"WITH {_MASTER_SQL} SELECT * FROM m")
def master_histogram(spark, sf_dir):
    return _master(spark, sf_dir)


@query("rebin_histogram", views="samples",
       oracle=_CENTRE_SQL + """, t AS (SELECT band, sum(count) AS total FROM m GROUP BY band)
         SELECT c.band AS band, CAST(greatest(0, least(n - 1, floor((v - a) / (b - a) * n))) AS INT) AS bin, CAST(sum(count) AS BIGINT) AS count,
           round(sum(count) * 100.0::DOUBLE / any_value(total), 6) AS pct
         FROM (SELECT *, CASE WHEN band = 'Dem_value' THEN 150 ELSE 200 END AS n FROM c) c JOIN t USING (band) WHERE v BETWEEN a AND b GROUP BY 1, 2""")
def rebin_histogram(spark, sf_dir):
    return rounded(hist.rebin_histogram(_master(spark, sf_dir), _norm_scales(spark), {"Dem_value": 150}))


@query("rebin_histogram_normalized", views="samples",
       oracle=_CENTRE_SQL + """, t AS (SELECT band, label, sum(count) AS total FROM m GROUP BY band, label)
         SELECT c.band AS band, c.label AS label, CAST(greatest(0, least(n - 1, floor(x * n))) AS INT) AS bin, CAST(sum(count) AS BIGINT) AS count,
           round(sum(count) * 100.0::DOUBLE / any_value(total), 6) AS pct
         FROM (SELECT *, CASE WHEN band = 'Dem_value' THEN 150 ELSE 200 END AS n,
                 CASE band WHEN 'V' THEN (v - a) / (b - a) WHEN 'K' THEN (v / b + 1) / 2 ELSE (v / 6.0::DOUBLE + 1) / 2 END AS x FROM c) c
         JOIN t USING (band, label) WHERE v BETWEEN a AND b GROUP BY 1, 2, 3""")
def rebin_histogram_normalized(spark, sf_dir):
    out = hist.rebin_histogram(
        _master(spark, sf_dir), _norm_scales(spark), {"Dem_value": 150}, kinds=_NORM_KINDS, group_by=["band", "label"]
    )
    return rounded(out)


@query("stats_from_histogram", views="samples",
       oracle=_CENTRE_SQL + """ SELECT band, CAST(sum(count) AS BIGINT) AS total_rows, round(coalesce(min(v) FILTER (v BETWEEN a AND b), 0), 6) AS min_centre,
         round(coalesce(max(v) FILTER (v BETWEEN a AND b), 0), 6) AS max_centre,
         round(coalesce(sum(v * count) FILTER (v BETWEEN a AND b) / sum(count) FILTER (v BETWEEN a AND b), 0), 6) AS mean FROM c GROUP BY band""")
def stats_from_histogram(spark, sf_dir):
    return rounded(hist.stats_from_histogram(_master(spark, sf_dir), _norm_scales(spark)))


_TRIM = """b AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1)"""


@query("trimmed_density",
       oracle=f"""WITH {_TRIM}, x AS (SELECT event_type, lo, hi, least(99, floor((value - lo) / ((hi - lo) / 100)))::INT AS bin
           FROM events JOIN b USING (event_type) WHERE value BETWEEN lo AND hi), t AS (SELECT event_type, count(*) AS total FROM x GROUP BY 1)
         SELECT event_type, round(lo, 6) AS lo, round(hi, 6) AS hi, bin, count(*) AS count, round(count(*) / (any_value(total) * ((hi - lo) / 100)), 9) AS density
         FROM x JOIN t USING (event_type) GROUP BY event_type, lo, hi, bin""")
def trimmed_density(spark, sf_dir):
    out = hist.trimmed_density(fx.table(spark, sf_dir, "events"), "value", 100, ["event_type"])
    return out.select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "bin", "count", F.round("density", 9).alias("density"))


@query("kde_bounds",
       oracle=f"""WITH {_TRIM}, m AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS s, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
         bins AS (SELECT event_type, least(2047, floor((value - mn) / ((mx - mn) / 2048)))::INT AS bin, count(*) AS c, avg(value) AS x
           FROM events JOIN m USING (event_type) GROUP BY 1, 2),
         g AS (SELECT event_type, i, lo + (hi - lo) * i / 1023 AS px, s * n ** (-0.2::DOUBLE) AS h FROM b JOIN m USING (event_type), range(1024) r(i)),
         y AS (SELECT event_type, i, px, sum(c * exp(-((px - x) ** 2) / (2 * h * h))) AS y FROM g JOIN bins USING (event_type) GROUP BY 1, 2, 3),
         a AS (SELECT event_type, i, px FROM y QUALIFY y > 0.015::DOUBLE * max(y) OVER (PARTITION BY event_type))
         SELECT event_type, round(CASE WHEN min(i) > 0 THEN arg_min(px, i) END, 6) AS x_left,
           round(CASE WHEN max(i) < 1023 THEN arg_max(px, i) END, 6) AS x_right FROM a GROUP BY 1""")
def kde_bounds(spark, sf_dir):
    return rounded(hist.kde_bounds(fx.table(spark, sf_dir, "events"), "value", ["event_type"]))
