"""Projections, scalar functions and filters on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock import names
from cellclock.functions import cleaning, clock, losses, scaling
from cellclock.grid import Grid
from cellclock.names import FULL, HISTORY, lag_name, q
from cellclock.operators import differences, filters
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query


def lag_list(bands, offsets=FULL):
    return ", ".join(f'"{lag_name(b, k)}"' for b in bands for k in offsets)


def lag_cols(bands, offsets=FULL):
    return [q(lag_name(b, k)) for b in bands for k in offsets]


# ---- time -------------------------------------------------------------------


@query(
    "ts_from_parts",
    views="strikes",
    oracle="SELECT event_id, date_trunc('minute', ts) AS t FROM strikes",
)
def ts_from_parts(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    parts = s.select(
        "event_id", *[f("ts").alias(n) for n, f in
                      (("y", F.year), ("mo", F.month), ("d", F.dayofmonth), ("h", F.hour), ("mi", F.minute))]
    )
    return parts.select("event_id", clock.ts_from_parts("y", "mo", "d", "h", "mi").alias("t"))


@query(
    "ceil_10min",
    views="strikes",
    oracle="""SELECT event_id, CASE WHEN minute(m) % 10 = 0 THEN m ELSE time_bucket(INTERVAL 10 MINUTE, m) + INTERVAL 10 MINUTE END AS t
      FROM (SELECT event_id, date_trunc('minute', ts) AS m FROM strikes)""",
)
def ceil_10min(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", clock.ceil_clock("ts").alias("t"))


@query(
    "floor_10min",
    oracle="SELECT event_id, time_bucket(INTERVAL 10 MINUTE, ts) AS t FROM events",
)
def floor_10min(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", clock.floor_clock("ts").alias("t"))


@query("floor_hour", oracle="SELECT event_id, date_trunc('hour', ts) AS t FROM events")
def floor_hour(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", clock.floor_hour("ts").alias("t"))


@query(
    "shift_10min",
    views="strikes",
    oracle="SELECT event_id, r.k AS k, t10 + r.k * INTERVAL 10 MINUTE AS t FROM strikes, (SELECT CAST(unnest(range(-6, 6)) AS INT) AS k) r",
)
def shift_10min(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    e = s.select("event_id", "t10", F.explode(F.sequence(F.lit(-6), F.lit(5))).alias("k"))
    return e.select("event_id", "k", clock.shift_clock("t10", F.col("k")).alias("t"))


@query(
    "format_ts",
    views="strikes",
    oracle="""SELECT event_id, strftime(t10, '%Y-%m-%d-%H-%M') AS dash, strftime(t10, '%Y%m%d') AS day,
      year(t10) || '/' || month(t10) || '/' || day(t10) || ':' || hour(t10) || 'h' || minute(t10) AS report FROM strikes""",
)
def format_ts(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    return s.select("event_id", *[clock.format_slot("t10", x).alias(x) for x in ("dash", "day", "report")])


@query(
    "parse_ts",
    views="strikes",
    oracle="SELECT event_id, t10 AS a, t10 AS b, t10 AS c, CAST(NULL AS TIMESTAMP) AS d FROM strikes",
)
def parse_ts(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select(
        "event_id",
        clock.format_slot("t10", "dash").alias("dash"),
        F.concat(clock.format_slot("t10", "report"), F.lit("; Band Missing: B"), F.col("kind")).alias("report"),
        F.concat(F.lit("A_s"), F.date_format("t10", "yyyyMMddHHmm"), F.lit("_e.nc")).alias("compact"),
        F.concat(F.lit("x"), F.col("kind")).alias("junk"),
    )
    return s.select(
        "event_id",
        clock.parse_slot("dash").alias("a"),
        clock.parse_slot("report").alias("b"),
        clock.parse_slot("compact", "compact").alias("c"),
        clock.parse_slot("junk").alias("d"),
    )


# ---- names ------------------------------------------------------------------


@query(
    "lag_columns",
    views="strikes px_hour samples",
    oracle=f"SELECT sid, {lag_list(('V', 'K'), HISTORY)} FROM samples",
)
def lag_columns(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    return s.select("sid", *[q(c) for c in names.lag_columns(["V", "K"], HISTORY, time_major=True)])


@query(
    "rename_columns",
    views="strikes px_hour samples",
    oracle='SELECT sid, "V_t-1" AS "B04B_t-1", "V_t-2" AS "B04B_t-2", "K_t-1" AS "B05B_t-1" FROM samples',
)
def rename_columns(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select(
        "sid", F.col("`V_t-1`").alias("N1B(10)"), F.col("`V_t-2`").alias("N1B_20p"), F.col("`K_t-1`").alias("N2B_t-1")
    )
    return names.rename_columns(s)


@query(
    "band_alias",
    views="strikes",
    oracle="""SELECT event_id, CASE kind WHEN 'click' THEN 'B04B' WHEN 'view' THEN 'B16B' ELSE kind END AS band FROM strikes""",
)
def band_alias(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    old = F.when(F.col("kind") == "click", "N1B").when(F.col("kind") == "view", "COB").otherwise(F.col("kind"))
    return s.select("event_id", names.band_alias(old).alias("band"))


@query("drop_columns", oracle="SELECT event_id, event_type FROM events")
def drop_columns(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return cleaning.drop_columns(e, ["ts", "user_id", "value", "props", "not_there"])


# ---- grid -------------------------------------------------------------------


@query(
    "lonlat_to_cell",
    views="points",
    oracle="""SELECT id, CAST(floor((18.0::DOUBLE - lat) / 0.2::DOUBLE) AS INT) AS row_floor, CAST(floor((lon - 103.0::DOUBLE) / 0.2::DOUBLE) AS INT) AS col_floor,
      CAST(trunc((18.0::DOUBLE - lat) / 0.2::DOUBLE) AS INT) AS row_trunc, CAST(trunc((lon - 103.0::DOUBLE) / 0.2::DOUBLE) AS INT) AS col_trunc FROM points""",
)
def lonlat_to_cell(spark, sf_dir):
    r1, c1 = fx.POINT_GRID.cell("lon", "lat")
    r2, c2 = fx.POINT_GRID.cell("lon", "lat", "truncate")
    return fx.points(spark, sf_dir).select(
        "id", r1.alias("row_floor"), c1.alias("col_floor"), r2.alias("row_trunc"), c2.alias("col_trunc")
    )


@query(
    "cell_in_bounds",
    views="strikes",
    oracle="""SELECT event_id, CASE WHEN "row" BETWEEN 0 AND 5 AND col BETWEEN 0 AND 9 THEN current END AS v FROM strikes""",
)
def cell_in_bounds(spark, sf_dir):
    grid = Grid(101.0, 24.0, 0.04, 0.04, 6, 10)
    s = fx.strikes(spark, sf_dir)
    return s.select("event_id", F.when(grid.contains("row", "col"), F.col("current")).alias("v"))


# ---- cleaning ---------------------------------------------------------------


@query(
    "band_difference",
    views="samples",
    oracle=f"""SELECT sid, {", ".join(f'"{lag_name("V", k)}" - "{lag_name("K", k)}" AS "{lag_name("V-K", k)}"' for k in FULL)} FROM samples""",
)
def band_difference(spark, sf_dir):
    out = differences.band_difference(fx.samples(spark, sf_dir), ["V-K", "V-ABSENT", "malformed"], FULL)
    return out.select("sid", *lag_cols(["V-K"]))


_PAIR_BANDS = ("click", "error", "view")


@query(
    "all_band_pairs",
    views="strikes",
    oracle="""WITH w AS (SELECT "row", col, max(current) FILTER (kind = 'click') AS a,
        max(current) FILTER (kind = 'error') AS b, max(current) FILTER (kind = 'view') AS c FROM strikes GROUP BY ALL)
      SELECT "row", col, round(a - b, 6) AS "click-error_t+0", round(a - c, 6) AS "click-view_t+0", round(b - c, 6) AS "error-view_t+0" FROM w""",
)
def all_band_pairs(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    wide = s.groupBy("row", "col").agg(
        *[F.max(F.when(F.col("kind") == b, F.col("current"))).alias(lag_name(b, 0)) for b in _PAIR_BANDS]
    )
    pairs = names.all_band_pairs(_PAIR_BANDS)
    out = differences.band_difference(wide, pairs, [0])
    return out.select("row", "col", *[F.round(q(lag_name(p, 0)), 6).alias(lag_name(p, 0)) for p in pairs])


@query(
    "cast_columns",
    oracle="""SELECT event_id, CAST(value AS FLOAT)::DOUBLE AS value, CAST(user_id AS INT) AS user_id, TRY_CAST(event_type AS DOUBLE) AS event_type FROM events""",
)
def cast_columns(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "value", "user_id", "event_type")
    e = cleaning.cast_columns(e, {"value": "float", "user_id": "int"})
    e = cleaning.cast_columns(e, ["value"], "double")
    return cleaning.cast_columns(e, ["event_type"], "double", strict=False)


@query(
    "replace_sentinel",
    views="dirty",
    oracle=f"""SELECT sid, {", ".join(f'CASE WHEN "{c}" = -9999.0 THEN -1.0::DOUBLE ELSE "{c}" END AS "{c}"' for c in names.lag_columns(["K"], FULL))} FROM dirty""",
)
def replace_sentinel(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir)
    return cleaning.replace_sentinel(d, "K", -9999.0, -1.0, FULL).select("sid", *lag_cols(["K"]))


@query(
    "sentinel_with_mask",
    views="dirty",
    oracle=f"""SELECT sid, {", ".join(f'CASE WHEN "{lag_name("K", k)}" = -9999.0 THEN -1.0::DOUBLE ELSE "{lag_name("K", k)}" END AS "{lag_name("K", k)}", CAST(CASE WHEN "{lag_name("K", k)}" = -9999.0 THEN 0 ELSE 1 END AS TINYINT) AS "{lag_name("KIsLand", k)}"' for k in FULL)} FROM dirty""",
)
def sentinel_with_mask(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir)
    out = cleaning.sentinel_with_mask(d, "K", -9999.0, -1.0, "KIsLand", FULL)
    return out.select("sid", *lag_cols(["K", "KIsLand"]))


@query(
    "nonfinite_to_null",
    views="dirty",
    oracle='SELECT sid, CASE WHEN isfinite("V_t-1") THEN "V_t-1" END AS v FROM dirty',
)
def nonfinite_to_null(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir)
    return d.select("sid", cleaning.nonfinite_to_null(q("V_t-1")).alias("v"))


@query(
    "normalize_missing",
    views="dirty",
    oracle="""SELECT sid, CASE WHEN isfinite("V_t-1") THEN "V_t-1" END AS "V_t-1", nullif("K_t-1", -9999.0) AS "K_t-1" FROM dirty""",
)
def normalize_missing(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir).select("sid", "`V_t-1`", "`K_t-1`")
    return cleaning.normalize_missing(d, ["V_t-1", "K_t-1"])


@query(
    "fill_default",
    views="samples",
    oracle="""SELECT sid, coalesce("V_t-6", 0.0) AS "V_t-6", coalesce("K_t+5", -1.0) AS "K_t+5" FROM samples""",
)
def fill_default(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("sid", "`V_t-6`", "`K_t+5`")
    return cleaning.fill_default(s, {"V_t-6": 0.0, "K_t+5": -1.0})


# ---- scaling ----------------------------------------------------------------

_RAW = "SELECT sid, {} AS v FROM samples"


def _scaled(spark, sf_dir, name, params, digits=None):
    s = fx.samples(spark, sf_dir).select("sid", F.col("`V_t-1`").alias("v"))
    out = scaling.apply_scaler(s, ["v"], name, params)
    return out if digits is None else out.withColumn("v", F.round("v", digits))


@query("scale_minmax", views="samples",
       oracle=_RAW.format('("V_t-1" - 5.0::DOUBLE) / (105.0::DOUBLE - 5.0::DOUBLE)'))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "MinMaxScaler", [5.0, 105.0])


@query("scale_minmax_guarded", views="samples",
       oracle="""SELECT sid, CASE WHEN "V_t-1" IS NOT NULL THEN 0.5::DOUBLE END AS zero,
         round(("V_t-1" - 5.0::DOUBLE) / (5e-11::DOUBLE + 1e-10::DOUBLE) * 1e-11, 4) AS tiny FROM samples""")
def scale_minmax_guarded(spark, sf_dir):
    v = q("V_t-1")
    tiny = scaling.scale_minmax(v - 5.0, F.lit(0.0), F.lit(5e-11)) * 1e-11
    return fx.samples(spark, sf_dir).select(
        "sid", scaling.scale_minmax(v, 5.0, 5.0).alias("zero"), F.round(tiny, 4).alias("tiny")
    )


@query("scale_robust", views="samples",
       oracle=_RAW.format('("V_t-1" - 14.0::DOUBLE) / (28.0::DOUBLE - 6.0::DOUBLE)'))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "RobustScaler", [6.0, 14.0, 28.0])


@query("scale_standard", views="samples", oracle=_RAW.format('("V_t-1" - 20.0::DOUBLE) / 13.0::DOUBLE'))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "StandardScaler", [20.0, 13.0])


@query(
    "scale_standard_fitted",
    views="samples",
    oracle=f"""WITH m AS (SELECT {", ".join(f'avg("{c}") AS "a{i}", stddev_pop("{c}") AS "s{i}"' for i, c in enumerate(names.lag_columns(["V"], HISTORY)))} FROM samples)
      SELECT sid, {", ".join(f'round(("{c}" - "a{i}") / "s{i}", 6) AS "{c}"' for i, c in enumerate(names.lag_columns(["V"], HISTORY)))} FROM samples, m""",
)
def scale_standard_fitted(spark, sf_dir):
    cols = names.lag_columns(["V"], HISTORY)
    s = fx.samples(spark, sf_dir).select("sid", *[q(c) for c in cols])
    out = differences.fit_standard(s, cols)
    return out.select("sid", *[F.round(q(c), 6).alias(c) for c in cols])


@query("scale_log1p", views="samples", oracle=_RAW.format('round(ln(1 + "V_t-1"), 9)'))
def scale_log1p(spark, sf_dir):
    return _scaled(spark, sf_dir, "LogScaler", [], 9)


@query("scale_by_constant", views="samples", oracle=_RAW.format('"V_t-1" / 560.21::DOUBLE'))
def scale_by_constant(spark, sf_dir):
    return _scaled(spark, sf_dir, "MaxScaler", [560.21])


@query("inverse_scale", views="samples",
       oracle=_RAW.format('round((("V_t-1" - 20.0::DOUBLE) / 13.0::DOUBLE) * 13.0::DOUBLE + 20.0::DOUBLE, 6)'))
def inverse_scale(spark, sf_dir):
    s = _scaled(spark, sf_dir, "StandardScaler", [20.0, 13.0])
    return s.select("sid", F.round(scaling.inverse_standard(F.col("v"), 20.0, 13.0), 6).alias("v"))


@query("scale_clip_pct", views="samples",
       oracle="""SELECT sid, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ("V_t-1" - 3.0::DOUBLE) / (60.0::DOUBLE - 3.0::DOUBLE))) AS pct,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, Dem_value / 4.0::DOUBLE)) AS maxabs FROM samples WHERE "V_t-1" IS NOT NULL""")
def scale_clip_pct(spark, sf_dir):
    s = fx.samples(spark, sf_dir).where("`V_t-1` IS NOT NULL")
    return s.select(
        "sid", scaling.scale_clip(q("V_t-1"), 3.0, 60.0).alias("pct"), scaling.scale_maxabs_clip(q("Dem_value"), 4.0).alias("maxabs")
    )


_SCALES = {"V": (0.5, 200.0), "K": (0.0, 99.0), "Dem_value": (-4.0, 6.0)}


@query(
    "normalize_by_kind",
    views="samples",
    oracle=f"""SELECT sid, {", ".join(f'("{c}" - 0.5::DOUBLE) / (200.0::DOUBLE - 0.5::DOUBLE) AS "{c}"' for c in names.lag_columns(["V"], HISTORY))},
      {", ".join(f'"{c}" / 99.0::DOUBLE AS "{c}"' for c in names.lag_columns(["K"], HISTORY))}, Dem_value / 6.0::DOUBLE AS Dem_value, lightning_0 FROM samples""",
)
def normalize_by_kind(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("sid", *lag_cols(["V", "K"], HISTORY), "Dem_value", "lightning_0")
    return scaling.normalize_by_kind(s, _SCALES, {"K": "max", "Dem_value": "maxabs"}, HISTORY, ["Dem_value"])


# ---- losses -----------------------------------------------------------------

_BCE = "(greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z))))"
_FOCAL = f"((0.25::DOUBLE * y + 0.75::DOUBLE * (1 - y)) * (1 - exp(-{_BCE})) ** 2.0 * {_BCE})"


@query("sigmoid_threshold", views="scored",
       oracle="""SELECT z, round(1 / (1 + exp(-z)), 9) AS p, CAST(1 / (1 + exp(-z)) >= 0.4::DOUBLE AS INT) AS yhat, count(*) AS n FROM scored GROUP BY ALL""")
def sigmoid_threshold(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    z = F.col("z")
    rows = s.select("z", F.round(losses.sigmoid(z), 9).alias("p"), losses.predict(z, 0.4).alias("yhat"))
    return rows.groupBy("z", "p", "yhat").agg(F.count(F.lit(1)).alias("n"))


@query("focal_loss", views="scored",
       oracle=f"SELECT round(avg({_FOCAL}), 9) AS focal, round(avg({_BCE}), 9) AS bce FROM scored")
def focal_loss(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    z, y = F.col("z"), F.col("y")
    return s.agg(
        F.round(F.avg(losses.focal_loss(z, y)), 9).alias("focal"), F.round(F.avg(losses.bce_with_logits(z, y)), 9).alias("bce")
    )


@query(
    "multitask_loss",
    views="scored",
    oracle=f"""SELECT round(exp(3.0) * avg((z / 10 - y) ** 2) - 1.5 + exp(3.0) * avg({_FOCAL}) - 1.5, 6) AS loss FROM scored""",
)
def multitask_loss(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    z, y = F.col("z"), F.col("y")
    mse, focal = F.avg(F.pow(z / 10 - y, F.lit(2.0))), F.avg(losses.focal_loss(z, y))
    return s.agg(F.round(losses.multitask_loss(mse, focal, -3.0, -3.0), 6).alias("loss"))


# ---- filters ----------------------------------------------------------------


@query("cell_window_filter", views="strikes",
       oracle="""SELECT event_id FROM strikes WHERE "row" BETWEEN 2 AND 7 AND col BETWEEN 3 AND 12 AND month(ts) IN (1, 2)""")
def cell_window_filter(spark, sf_dir):
    return filters.cell_window_filter(fx.strikes(spark, sf_dir), (2, 7), (3, 12), (1, 2)).select("event_id")


@query("bbox_filter", views="points",
       oracle="SELECT id FROM points WHERE lon BETWEEN 105.5 - 0.5 AND 106.0 + 0.5 AND lat BETWEEN 15.0 - 0.5 AND 15.2 + 0.5")
def bbox_filter(spark, sf_dir):
    return filters.bbox_filter(fx.points(spark, sf_dir), (105.5, 106.0), (15.0, 15.2)).select("id")


@query("calendar_filter",
       oracle="SELECT event_id FROM events WHERE month(ts) = 1 AND year(ts) IN (2023, 2024) AND (hour(ts) >= 20 OR hour(ts) < 5)")
def calendar_filter(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return filters.calendar_filter(e, months=[1], years=[2023, 2024], night=True).select("event_id")


@query("drop_missing", views="dirty",
       oracle=f"""SELECT sid FROM dirty WHERE {" AND ".join(f'"{c}" IS NOT NULL AND NOT isnan("{c}")' for c in names.lag_columns(["V", "K"], FULL))}""")
def drop_missing(spark, sf_dir):
    d = fx.dirty_samples(spark, sf_dir)
    return cleaning.drop_missing(d, [*names.lag_columns(["V", "K"], FULL), "not_there"]).select("sid")


@query("negatives_only", views="samples", oracle="SELECT sid FROM samples WHERE output_0 = 0")
def negatives_only(spark, sf_dir):
    return filters.negatives_only(fx.samples(spark, sf_dir)).select("sid")


def _all(band, op, limit, other=None):
    expr = '"{a}"' if other is None else '("{a}" - "{b}")'
    return " AND ".join(
        expr.format(a=lag_name(band, k), b=lag_name(other or "", k)) + f" {op} {limit}" for k in FULL
    )


@query(
    "all_lags_predicate",
    views="samples",
    oracle=f"""SELECT sid FROM samples WHERE (Dem_value > 0 AND {_all('V', '>=', 4.0)} AND {_all('V', '>=', -70.0, 'K')})
      OR (NOT Dem_value > 0 AND {_all('V', '>=', 5.0)} AND {_all('V', '<=', 30.0, 'K')})""",
)
def all_lags_predicate(spark, sf_dir):
    s = differences.band_difference(fx.samples(spark, sf_dir), ["V-K"], FULL)
    out = filters.physical_cloud_filter(
        s, F.col("Dem_value") > 0, "V", "V-K", "V-K", land_min=4.0, land_diff_min=-70.0, sea_min=5.0, sea_diff_max=30.0
    )
    return out.select("sid")


@query("polarity_split", views="strikes",
       oracle="""SELECT (CASE WHEN k - 50 > 0 THEN 'pos' WHEN k - 50 < 0 THEN 'neg' END) || '_' ||
           (CASE WHEN kind = 'error' THEN 'ground' ELSE 'cloud' END) AS class, count(*) AS n FROM strikes GROUP BY 1""")
def polarity_split(spark, sf_dir):
    s = fx.strikes(spark, sf_dir)
    kind = F.when(F.col("kind") == "error", 0).otherwise(1)
    return s.groupBy(filters.polarity_class(F.col("k") - 50, kind).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("range_filter", views="strikes",
       oracle="SELECT event_id, current >= 10 AND current < 20 AS half_open FROM strikes WHERE current BETWEEN 10 AND 20")
def range_filter(spark, sf_dir):
    s = filters.range_filter(fx.strikes(spark, sf_dir), "current", 10, 20)
    inside = filters.range_filter(s, "current", 10, 20, half_open=True).select("event_id", F.lit(True).alias("half_open"))
    rest = s.where(F.col("current") >= 20).select("event_id", F.lit(False).alias("half_open"))
    return inside.unionByName(rest)
