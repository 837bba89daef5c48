"""Lookup joins on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock.names import FULL, HORIZONS, lag_name
from cellclock.operators import lookups
from cellclock.operators.lags import lag_features
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query

BANDS = ("click", "view", "error")


def _lag_sql(bands, offsets, template):
    return ", ".join(template.format(band=b, k=k, name=lag_name(b, k)) for k in offsets for b in bands)


@query(
    "grid_time_lookup",
    views="strikes px10",
    oracle=f"""SELECT s.event_id, {_lag_sql(BANDS, range(-1, -7, -1),
        "max(p.value) FILTER (p.band = '{band}' AND p.ts = s.t10 + INTERVAL ({k} * 10) MINUTE) AS " + '"{name}"')}
      FROM strikes s LEFT JOIN px10 p ON p."row" = s."row" AND p.col = s.col
        AND p.ts BETWEEN s.t10 - INTERVAL 60 MINUTE AND s.t10 - INTERVAL 10 MINUTE
      GROUP BY s.event_id""",
)
def grid_time_lookup(spark, sf_dir):
    strikes = fx.strikes(spark, sf_dir).select("event_id", F.col("t10").alias("ts"), "row", "col")
    return lookups.grid_time_lookup(strikes, fx.px10(spark, sf_dir), BANDS).drop("ts", "row", "col")


@query(
    "hourly_lookup",
    views="strikes px_hour",
    oracle=f"""SELECT s.event_id, {_lag_sql(("VAL", "KEY"), FULL,
        "max(h.{band}) FILTER (h.ts = date_trunc('hour', s.t10 + INTERVAL ({k} * 10) MINUTE)) AS " + '"{name}"')}
      FROM strikes s LEFT JOIN px_hour h ON h."row" = s.crow AND h.col = s.ccol
        AND h.ts BETWEEN s.t10 - INTERVAL 2 HOUR AND s.t10 + INTERVAL 2 HOUR
      GROUP BY s.event_id""",
)
def hourly_lookup(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select(
        "event_id", F.col("t10").alias("ts"), F.col("crow").alias("row"), F.col("ccol").alias("col")
    )
    return lookups.hourly_lookup(s, fx.px_hour(spark, sf_dir), ["VAL", "KEY"]).drop("ts", "row", "col")


@query(
    "asof_backward_lookup",
    views="strikes px_day",
    oracle="""WITH dates AS (SELECT DISTINCT date FROM px_day),
      mapped AS (SELECT s.event_id, s.crow, s.ccol,
          coalesce(d.date, (SELECT min(date) FROM dates)) AS date
        FROM strikes s ASOF LEFT JOIN dates d ON CAST(s.ts AS DATE) >= d.date)
      SELECT m.event_id, p.value AS ndvi FROM mapped m
      LEFT JOIN px_day p ON p.date = m.date AND p."row" = m.crow AND p.col = m.ccol""",
)
def asof_backward_lookup(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select("event_id", "ts", F.col("crow").alias("row"), F.col("ccol").alias("col"))
    return lookups.asof_backward_lookup(s, fx.px_day(spark, sf_dir), "value", "ndvi").select("event_id", "ndvi")


@query(
    "asof_backward_lags",
    views="strikes px_day",
    oracle=f"""WITH dates AS (SELECT DISTINCT date FROM px_day),
      asked AS (SELECT event_id, crow, ccol, r.k AS k, CAST(t10 + r.k * INTERVAL 10 MINUTE AS DATE) AS day
        FROM strikes, range(-6, 6) r(k)),
      mapped AS (SELECT a.event_id, a.crow, a.ccol, a.k,
          coalesce(d.date, (SELECT min(date) FROM dates)) AS date
        FROM asked a ASOF LEFT JOIN dates d ON a.day >= d.date)
      SELECT m.event_id, {", ".join(f'max(p.value) FILTER (m.k = {k}) AS "{lag_name("NDVI", k)}"' for k in FULL)}
      FROM mapped m LEFT JOIN px_day p ON p.date = m.date AND p."row" = m.crow AND p.col = m.ccol
      GROUP BY m.event_id""",
)
def asof_backward_lags(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select(
        "event_id", F.col("t10").alias("ts"), F.col("crow").alias("row"), F.col("ccol").alias("col")
    )
    out = lookups.asof_backward_lookup(s, fx.px_day(spark, sf_dir), "value", lambda k: lag_name("NDVI", k), FULL)
    return out.drop("ts", "row", "col")


@query(
    "static_lookup",
    views="strikes static",
    oracle="""SELECT event_id, v.value AS Dem_value FROM strikes s
      LEFT JOIN static v ON v."row" = s.crow AND v.col = s.ccol""",
)
def static_lookup(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select("event_id", F.col("crow").alias("row"), F.col("ccol").alias("col"))
    return lookups.static_lookup(s, fx.static(spark, sf_dir)).select("event_id", "Dem_value")


@query(
    "horizon_label_join",
    views="strikes px10",
    oracle=f"""SELECT s.event_id, {", ".join(
        f"coalesce(max(p.value) FILTER (p.ts = s.t10 + INTERVAL ({k} * 10) MINUTE), 0.0) AS lightning_{k}"
        for k in range(HORIZONS))}
      FROM strikes s LEFT JOIN px10 p ON p.band = 'error' AND p."row" = s."row" AND p.col = s.col
        AND p.ts BETWEEN s.t10 AND s.t10 + INTERVAL 50 MINUTE
      GROUP BY s.event_id""",
)
def horizon_label_join(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select("event_id", F.col("t10").alias("ts"), "row", "col")
    amounts = fx.px10(spark, sf_dir).where("band = 'error'").select("ts", "row", "col", F.col("value").alias("amount"))
    return lookups.horizon_label_join(s, amounts).drop("ts", "row", "col")


_HAVERSINE = """2 * 6371 * asin(sqrt(least(1.0, sin((radians(p.lat) - radians(s.lat)) / 2) ** 2
   + cos(radians(s.lat)) * cos(radians(p.lat)) * sin((radians(p.lon) - radians(s.lon)) / 2) ** 2)))"""


@query(
    "nearest_station",
    views="strikes",
    oracle=f"""WITH places(ord, name, lat, lon) AS (VALUES {", ".join(
        f"({i}, '{n}', {la}::DOUBLE, {lo}::DOUBLE)" for i, (n, la, lo) in enumerate(lookups.STATIONS))}),
      d AS (SELECT s.event_id, p.name, p.ord, {_HAVERSINE} AS km FROM strikes s, places p)
      SELECT event_id, arg_min(name, (km, ord)) AS station, round(min(km), 6) AS distance_km FROM d GROUP BY event_id""",
)
def nearest_station(spark, sf_dir):
    near = lookups.nearest_station(fx.strikes(spark, sf_dir).select("event_id", "lat", "lon"))
    return near.select("event_id", "station", F.round("distance_km", 6).alias("distance_km"))


@query(
    "haversine_km",
    views="strikes",
    oracle=f"SELECT event_id, round({_HAVERSINE}, 6) AS km FROM strikes s, (SELECT 21.0::DOUBLE AS lat, 105.8::DOUBLE AS lon) p",
)
def haversine(spark, sf_dir):
    from cellclock.functions.geo import haversine_km

    s = fx.strikes(spark, sf_dir)
    return s.select("event_id", F.round(haversine_km("lat", "lon", F.lit(21.0), F.lit(105.8)), 6).alias("km"))


def _days(spark, scenes):
    """All slots of the days from the first scene to the last."""
    a, b = scenes.agg(F.date_format(F.min("ts"), "yyyy-MM-dd"), F.date_format(F.max("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")).first()
    return lookups.calendar(spark, a, b)


@query(
    "availability_calendar",
    views="strikes px10",
    oracle="""WITH slots AS (SELECT unnest(generate_series(date_trunc('day', a), date_trunc('day', b) + INTERVAL '23 hours 50 minutes', INTERVAL 10 MINUTE)) AS ts FROM (SELECT min(ts) AS a, max(ts) AS b FROM px10)),
      known AS (SELECT DISTINCT ts, band FROM px10),
      names(band, other) AS (VALUES ('click', 'view'), ('error', NULL), ('purchase', NULL), ('signup', NULL), ('view', NULL))
      SELECT s.ts, n.band, CASE WHEN a.band IS NOT NULL THEN 'ok' WHEN b.band IS NOT NULL THEN 'alias' ELSE 'absent' END AS status
      FROM slots s CROSS JOIN names n
      LEFT JOIN known a ON a.ts = s.ts AND a.band = n.band
      LEFT JOIN known b ON b.ts = s.ts AND b.band = n.other""",
)
def availability_calendar(spark, sf_dir):
    scenes = fx.px10(spark, sf_dir)
    return lookups.availability_calendar(_days(spark, scenes), ["click", "error", "purchase", "signup", "view"], scenes, {"click": "view"})


@query(
    "anti_join_missing",
    views="strikes px10",
    oracle="""SELECT DISTINCT ts FROM px10 p WHERE band = 'click'
      AND NOT EXISTS (SELECT 1 FROM px10 o WHERE o.band = 'error' AND o.ts = p.ts)""",
)
def anti_join_missing(spark, sf_dir):
    px = fx.px10(spark, sf_dir)
    have = px.where("band = 'click'").select("ts").distinct()
    return lookups.anti_join_missing(have, px.where("band = 'error'"), ["ts"])


@query(
    "semi_join_known",
    views="strikes px10",
    oracle="""SELECT event_id FROM strikes s WHERE EXISTS (
      SELECT 1 FROM px10 o WHERE o.band = 'error' AND o.ts = s.t10 AND o."row" = s."row" AND o.col = s.col)""",
)
def semi_join_known(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).select("event_id", F.col("t10").alias("ts"), "row", "col")
    return lookups.semi_join_known(s, fx.px10(spark, sf_dir).where("band = 'error'"), ["ts", "row", "col"]).select("event_id")


@query(
    "align_columns",
    views="strikes px_hour samples",
    oracle="""SELECT sid, "V_t-1", "V_t-1" - "K_t-1" AS "V-K_t-1" FROM samples""",
)
def align_columns(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    diff = s.select("sid", (F.col("`V_t-1`") - F.col("`K_t-1`")).alias("V-K_t-1"))
    return lookups.align_columns(s.select("sid", "`V_t-1`"), diff, ["sid"])


@query(
    "rank_join",
    views="strikes",
    oracle="""WITH r AS (SELECT kind AS feature, row_number() OVER (ORDER BY count(*) DESC, kind) AS rank_1,
        row_number() OVER (ORDER BY sum(k) DESC, kind) AS rank_2,
        row_number() OVER (ORDER BY max(current) DESC, kind) AS rank_3 FROM strikes GROUP BY kind)
      SELECT * FROM r""",
)
def rank_join(spark, sf_dir):
    from pyspark.sql import Window

    s = fx.strikes(spark, sf_dir)

    def ranked(agg):
        # one row per band, so this window is over a handful of rows
        w = Window.orderBy(F.desc("_s"), "feature")
        t = s.groupBy(F.col("kind").alias("feature")).agg(agg.alias("_s"))
        return t.select("feature", F.row_number().over(w).alias("rank"))

    return lookups.rank_join(ranked(F.count(F.lit(1))), ranked(F.sum("k")), ranked(F.max("current")))


@query(
    "lag_features",
    views="strikes px_hour samples",
    oracle=f"""SELECT ts, "row", col, {", ".join(f'"{lag_name("V", k)}"' for k in FULL)} FROM samples""",
)
def lag_features_query(spark, sf_dir):
    h = fx.px_hour(spark, sf_dir).select("ts", "row", "col", F.col("VAL").alias("V"))
    return lag_features(h, ["V"], FULL, fx.SCENE_MINUTES, chunk=24).drop("V")
