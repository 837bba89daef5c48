"""Views that give the driver tables the shape of the observed data.

Each view exists twice: as a DataFrame and as a SQL common table expression with
the same columns, so that a query and its oracle start from the same rows. Means
are taken over whole cents, which makes them independent of the order of rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellclock.functions.clock import ceil_clock, epoch_minutes, floor_hour
from cellclock.grid import Grid
from cellclock.names import FULL, HORIZONS, lag_name
from cellclock.operators.lags import lag_features

STRIKE_GRID = Grid(101.0, 24.0, 0.04, 0.04, 438, 15)
POINT_GRID = Grid(103.0, 18.0, 0.2, 0.2, 30, 30)
SCENE_MINUTES = 60  # sample clock: one scene an hour, dense enough for 12 lags
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event on a 15-wide grid (``row``, ``col``) and on a coarser one
    of three columns (``crow``, ``ccol``)."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    base = e.select(
        "event_id",
        "ts",
        F.floor(user / 15).cast("int").alias("row"),
        F.pmod(user, F.lit(15)).cast("int").alias("col"),
        F.floor(user / 75).cast("int").alias("crow"),
        F.floor(F.pmod(user, F.lit(75)) / 25).cast("int").alias("ccol"),
        F.col("value").alias("current"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        ceil_clock("ts").alias("t10"),
    )
    lon, lat = STRIKE_GRID.center("row", "col")
    return base.withColumns({"lon": lon, "lat": lat})


STRIKES = """strikes AS (
  SELECT event_id, ts, CAST(user_id // 15 AS INT) AS "row", CAST(user_id % 15 AS INT) AS col,
    CAST(user_id // 75 AS INT) AS crow, CAST((user_id % 75) // 25 AS INT) AS ccol,
    value AS current, event_type AS kind,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    make_timestamp(((epoch_us(ts) // 60000000 + 9) // 10) * 600000000) AS t10,
    101.0::DOUBLE + ((user_id % 15) + 0.5::DOUBLE) * 0.04::DOUBLE AS lon,
    24.0::DOUBLE - ((user_id // 15) + 0.5::DOUBLE) * 0.04::DOUBLE AS lat
  FROM events)"""


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


def mean_of_cents(name: str):
    return F.sum(_cents(name)) / (F.count(name) * 100)


def px10(spark, sf_dir) -> DataFrame:
    """Long pixel table on the 10-minute clock; the event type is the band."""
    s = strikes(spark, sf_dir)
    return s.groupBy(F.col("kind").alias("band"), F.col("t10").alias("ts"), "row", "col").agg(
        mean_of_cents("current").alias("value")
    )


PX10 = """px10 AS (
  SELECT kind AS band, t10 AS ts, "row", col,
    CAST(sum(CAST(round(current * 100) AS BIGINT)) AS BIGINT) / (count(current) * 100) AS value
  FROM strikes GROUP BY ALL)"""


def px_hour(spark, sf_dir) -> DataFrame:
    """Hourly values VAL and KEY on the coarse grid, one row per (hour, cell)."""
    s = strikes(spark, sf_dir)
    return s.groupBy(
        floor_hour("ts").alias("ts"), F.col("crow").alias("row"), F.col("ccol").alias("col")
    ).agg(
        mean_of_cents("current").alias("VAL"),
        (F.sum("k") / F.count("k")).alias("KEY"),
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("kind") == "error").cast("int")).alias("n_err"),
        (F.sum(F.when(F.col("kind") == "error", _cents("current")).otherwise(0)) / F.lit(100)).alias("amount"),
    )


PX_HOUR = """px_hour AS (
  SELECT date_trunc('hour', ts) AS ts, crow AS "row", ccol AS col,
    CAST(sum(CAST(round(current * 100) AS BIGINT)) AS BIGINT) / (count(current) * 100) AS VAL,
    CAST(sum(k) AS BIGINT) / count(k) AS KEY, count(*) AS n,
    CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS n_err,
    CAST(coalesce(sum(CAST(round(current * 100) AS BIGINT)) FILTER (kind = 'error'), 0) AS BIGINT) / 100 AS amount
  FROM strikes GROUP BY ALL)"""


def px_day(spark, sf_dir) -> DataFrame:
    """Rasters dated the 3rd and the 19th, each from all events of its part of the month;
    events before the 3rd test the clip."""
    s = strikes(spark, sf_dir)
    dated = F.date_add(F.trunc("ts", "month"), F.when(F.dayofmonth("ts") < 19, 2).otherwise(18))
    return s.groupBy(dated.alias("date"), F.col("crow").alias("row"), F.col("ccol").alias("col")).agg(
        mean_of_cents("current").alias("value")
    )


PX_DAY = """px_day AS (
  SELECT CAST(CAST(date_trunc('month', ts) AS DATE) + CASE WHEN day(ts) < 19 THEN 2 ELSE 18 END AS DATE) AS date, crow AS "row", ccol AS col,
    CAST(sum(CAST(round(current * 100) AS BIGINT)) AS BIGINT) / (count(current) * 100) AS value
  FROM strikes GROUP BY ALL)"""


def static(spark, sf_dir, coarse: bool = True) -> DataFrame:
    r, c = ("crow", "ccol") if coarse else ("row", "col")
    cells = strikes(spark, sf_dir).select(F.col(r).alias("row"), F.col(c).alias("col")).distinct()
    return cells.withColumn("value", (F.pmod(F.col("row") * 7 + F.col("col") * 5, F.lit(11)) - 4).cast("double"))


STATIC = """static AS (
  SELECT "row", col, CAST(("row" * 7 + col * 5) % 11 - 4 AS DOUBLE) AS value
  FROM (SELECT DISTINCT crow AS "row", ccol AS col FROM strikes))"""
STATIC_FINE = """static_fine AS (
  SELECT "row", col, CAST(("row" * 7 + col * 5) % 11 - 4 AS DOUBLE) AS value
  FROM (SELECT DISTINCT "row", col FROM strikes))"""


def samples(spark, sf_dir) -> DataFrame:
    """Wide lag table: V and K lags, static value, six labels and amounts. ``sid``
    is a unique integer key that grows with the cell, then with time."""
    hour = px_hour(spark, sf_dir)
    lagged = lag_features(
        hour.select("ts", "row", "col", F.col("VAL").alias("V"), F.col("KEY").alias("K"), "n_err", "amount"),
        ["V", "K", "n_err", "amount"],
        FULL,
        SCENE_MINUTES,
        chunk=24,
    )
    names = [f"`{lag_name(b, k)}`" for b in ("V", "K") for k in FULL]
    hours = epoch_minutes("ts") / 60
    return lagged.select(
        ((F.col("row") * 3 + F.col("col")).cast("long") * 1000000 + hours.cast("long")).alias("sid"),
        "ts",
        "row",
        "col",
        *names,
        (F.pmod(F.col("row") * 7 + F.col("col") * 5, F.lit(11)) - 4).cast("double").alias("Dem_value"),
        *[F.expr(f"CAST(coalesce(`{lag_name('n_err', i)}`, 0) > 0 AS int) AS output_{i}") for i in range(HORIZONS)],
        *[F.expr(f"coalesce(`{lag_name('amount', i)}`, 0D) AS lightning_{i}") for i in range(HORIZONS)],
    )


@cache
def _samples_sql() -> str:
    lag = [
        f'max(p.{src}) FILTER (p.off = {k}) AS "{lag_name(b, k)}"'
        for b, src in (("V", "VAL"), ("K", "KEY"))
        for k in FULL
    ]
    out = [f"CAST(coalesce(max(p.n_err) FILTER (p.off = {i}), 0) > 0 AS INT) AS output_{i}" for i in range(HORIZONS)]
    amt = [f"coalesce(max(p.amount) FILTER (p.off = {i}), 0.0) AS lightning_{i}" for i in range(HORIZONS)]
    return f"""samples AS (
  SELECT (p.crow * 3 + p.ccol)::BIGINT * 1000000 + epoch_us(p.t) // 3600000000 AS sid,
    p.t AS ts, p.crow AS "row", p.ccol AS col, {', '.join(lag)},
    CAST((p.crow * 7 + p.ccol * 5) % 11 - 4 AS DOUBLE) AS Dem_value, {', '.join(out)}, {', '.join(amt)}
  FROM (SELECT b.ts AS t, b."row" AS crow, b.col AS ccol,
               epoch_us(h.ts) // 3600000000 - epoch_us(b.ts) // 3600000000 AS off, h.*
        FROM px_hour b JOIN px_hour h ON b."row" = h."row" AND b.col = h.col
         AND h.ts BETWEEN b.ts - INTERVAL 6 HOUR AND b.ts + INTERVAL 5 HOUR) p
  GROUP BY p.t, p.crow, p.ccol)"""


def dirty_samples(spark, sf_dir) -> DataFrame:
    """Sentinels in K where sid % 17 = 0, NaN in V_t-1 where sid % 19 = 0, and every
    row with sid % 23 = 0 twice."""
    s = samples(spark, sf_dir)
    new = {lag_name("K", k): F.when(F.col("sid") % 17 == 0, -9999.0).otherwise(F.col(f"`{lag_name('K', k)}`")) for k in FULL}
    new["V_t-1"] = F.when(F.col("sid") % 19 == 0, float("nan")).otherwise(F.col("`V_t-1`"))
    s = s.withColumns(new)
    copies = F.when(F.col("sid") % 23 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return s.select("*", F.explode(copies).alias("_copy")).drop("_copy")


@cache
def _dirty_sql() -> str:
    new = ", ".join(
        [f'CASE WHEN sid % 17 = 0 THEN -9999.0::DOUBLE ELSE "{lag_name("K", k)}" END AS "{lag_name("K", k)}"' for k in FULL]
        + ["CASE WHEN sid % 19 = 0 THEN 'nan'::DOUBLE ELSE \"V_t-1\" END AS \"V_t-1\""]
    )
    return f"""dirty AS (
  SELECT * REPLACE ({new}) FROM samples
  UNION ALL
  SELECT * REPLACE ({new}) FROM samples WHERE sid % 23 = 0)"""


def mask(spark, sf_dir) -> DataFrame:
    """Flagged cells of a scene: mean error value above 20."""
    return px10(spark, sf_dir).where((F.col("band") == "error") & (F.col("value") > 20)).select("ts", "row", "col")


MASK = """mask AS (SELECT ts, "row", col FROM px10 WHERE band = 'error' AND value > 20)"""


def points(spark, sf_dir) -> DataFrame:
    """Irregular points from the first two embedding components."""
    e = table(spark, sf_dir, "embeddings")
    a, b = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return e.select(
        F.col("vec_id").alias("id"),
        (101 + 5 * (1 + a)).alias("lon"),
        (15 + 5 * b).alias("lat"),
        F.col("label").cast("double").alias("value"),
    )


POINTS = """points AS (
  SELECT vec_id AS id, 101 + 5 * (1 + CAST(embedding[1] AS DOUBLE)) AS lon,
    15 + 5 * CAST(embedding[2] AS DOUBLE) AS lat, CAST(label AS DOUBLE) AS value FROM embeddings)"""


def scored(spark, sf_dir) -> DataFrame:
    """Binary labels with logits of eleven levels, so that ties are common."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.least(F.col("l_linenumber") - 1, F.lit(5)).cast("int").alias("horizon"),
        (F.round(F.col("l_discount") * 100) - 5).cast("double").alias("z"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


SCORED = """scored AS (
  SELECT CAST(least(l_linenumber - 1, 5) AS INT) AS horizon, CAST(round(l_discount * 100) - 5 AS DOUBLE) AS z,
    CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"""


def fine_scored(spark, sf_dir) -> DataFrame:
    """As ``scored`` with many distinct scores: the extended price in millions."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.least(F.col("l_linenumber") - 1, F.lit(5)).cast("int").alias("horizon"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


FINE_SCORED = """fine_scored AS (
  SELECT CAST(least(l_linenumber - 1, 5) AS INT) AS horizon, l_extendedprice AS score,
    CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"""


def regress(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    j = li.join(part, "l_partkey")
    return j.select(
        F.least(F.col("l_linenumber") - 1, F.lit(5)).cast("int").alias("horizon"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0).alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"),
    )


REGRESS = """regress AS (
  SELECT CAST(least(l_linenumber - 1, 5) AS INT) AS horizon,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0::DOUBLE END AS y,
    l_quantity * p_retailprice AS yhat
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def features(spark, sf_dir, bands: int = 2) -> DataFrame:
    """Embedding components as bands of six lags, label >= 5 as the class."""
    e = table(spark, sf_dir, "embeddings")
    cols = [
        F.element_at("embedding", 6 * b + i + 1).cast("double").alias(lag_name(chr(65 + b), i - 6))
        for b in range(bands)
        for i in range(6)
    ]
    return e.select(F.col("vec_id").alias("id"), *cols, (F.col("label") >= 5).cast("int").alias("y"))


@cache
def _features_sql(bands: int = 2) -> str:
    cols = ", ".join(
        f'CAST(embedding[{6 * b + i + 1}] AS DOUBLE) AS "{lag_name(chr(65 + b), i - 6)}"'
        for b in range(bands)
        for i in range(6)
    )
    return f"features AS (SELECT vec_id AS id, {cols}, CAST(label >= 5 AS INT) AS y FROM embeddings)"


_NEEDS = {
    "px10": ["strikes"],
    "px_hour": ["strikes"],
    "px_day": ["strikes"],
    "static": ["strikes"],
    "static_fine": ["strikes"],
    "samples": ["strikes", "px_hour"],
    "dirty": ["strikes", "px_hour", "samples"],
    "mask": ["strikes", "px10"],
}


def _cte(name: str) -> str:
    fixed = {
        "strikes": STRIKES, "px10": PX10, "px_hour": PX_HOUR, "px_day": PX_DAY, "static": STATIC,
        "static_fine": STATIC_FINE, "mask": MASK, "points": POINTS, "scored": SCORED,
        "fine_scored": FINE_SCORED, "regress": REGRESS,
    }
    if name == "samples":
        return _samples_sql()
    if name == "dirty":
        return _dirty_sql()
    if name == "features":
        return _features_sql()
    return fixed[name]


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` (a SELECT, or further ``name AS (…)`` and a SELECT after the
    word ``WITH``) with the named views and all they need."""
    order: list[str] = []
    for name in views.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    body = body.strip()
    ctes = [_cte(n) for n in order]
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join(ctes) + ",\n" + body[len(start) :]
    return "WITH " + ",\n".join(ctes) + "\n" + body
