"""Joins of events and samples with gridded, regularly timed values.

Every lookup follows the same pattern: reduce the probe side to distinct
(cell, slot) requests, which a map-side aggregate does before the shuffle, answer
each request once, and join the answers back. The answer side is unique per key,
so a hot cell only makes the probe side long, and adaptive execution may split it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.functions.clock import shift_clock
from cellclock.functions.geo import STATIONS, haversine_km, nearest_place, unit_vector
from cellclock.names import FULL, HORIZONS, lag_name, q
from cellclock.operators.keyed import lookup

CELL = ("row", "col")


def bands_to_columns(
    pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("ts", "row", "col")
) -> DataFrame:
    """Long ``(band, ts, row, col, value)`` to one column per listed band. A band
    has one value per key; the first non-null is taken in one partial aggregate."""
    return (
        pixels.where(F.col("band").isin(*bands))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])
    )


def offset_vectors(
    requests: DataFrame,
    table: DataFrame,
    columns: Sequence[str],
    offsets: Sequence[int],
    name,
    step: int = 10,
    ts: str = "ts",
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """One row per distinct request with ``column`` at each offset.

    ``name(column, offset)`` gives the output name. ``table`` is unique per
    (ts, cell); what it does not hold is NULL.
    """
    keys = [ts, *cell]
    wanted = requests.select(*keys).distinct()
    asked = wanted.select(*keys, F.explode(F.array(*[F.lit(k) for k in offsets])).alias("_k"))
    asked = asked.withColumn("_at", shift_clock(ts, F.col("_k"), step))
    facts = table.select(F.col(ts).alias("_at"), *cell, *[q(c) for c in columns])
    # Inner join: a request without any hit still reaches the caller's left join.
    found = asked.join(facts, ["_at", *cell])
    return found.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN _k = {k} THEN `{c}` END) AS `{name(c, k)}`") for k in offsets for c in columns]
    )


def attach_offsets(
    df: DataFrame,
    table: DataFrame,
    columns: Sequence[str],
    offsets: Sequence[int],
    name=lag_name,
    step: int = 10,
    ts: str = "ts",
    cell: Sequence[str] = CELL,
) -> DataFrame:
    vectors = offset_vectors(df, table, columns, offsets, name, step, ts, cell)
    return lookup(df, vectors, [ts, *cell])


def grid_time_lookup(
    strikes: DataFrame,
    pixels: DataFrame,
    bands: Sequence[str],
    steps_back: Sequence[int] = (1, 2, 3, 4, 5, 6),
    step: int = 10,
    ts: str = "ts",
) -> DataFrame:
    """Values of ``bands`` at the strike's cell, 1..6 scenes before its slot, as
    ``BAND_t-k`` columns, time-major. Absent scenes and cells are NULL. The pixel table
    is pruned by the requests before anything else happens to it."""
    from cellclock.operators.assembly import assemble, scenes

    return assemble(strikes, [scenes(pixels, bands, [-k for k in steps_back])], ts, step)


def horizon_label_join(
    df: DataFrame, amounts: DataFrame, n: int = HORIZONS, step: int = 10, ts: str = "ts", default: float = 0.0
) -> DataFrame:
    """``lightning_k``: the amount at the same cell k slots later, ``default`` when
    nothing struck. ``amounts`` is unique per (ts, row, col)."""
    out = attach_offsets(df, amounts, ["amount"], range(n), lambda _, k: f"lightning_{k}", step, ts)
    return out.withColumns({f"lightning_{k}": F.coalesce(F.col(f"lightning_{k}"), F.lit(default)) for k in range(n)})


def hourly_lookup(
    df: DataFrame,
    hourly: DataFrame,
    variables: Sequence[str],
    offsets: Sequence[int] = FULL,
    step: int = 10,
    ts: str = "ts",
) -> DataFrame:
    """``VAR_t±k`` from hourly values: the hour that holds ``ts + k*step``.

    All offsets of a row fall into a few hours around it, so only distinct
    (hour, cell) keys are looked up and the 12 columns are picked by arithmetic.
    """
    first = (min(offsets) * step) // 60
    last = (59 + max(offsets) * step) // 60
    hours = range(first, last + 1)
    keyed = df.withColumn("_hour", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz"))
    table = hourly.withColumnRenamed("ts", "_hour")
    near = offset_vectors(keyed, table, variables, hours, lambda v, h: f"_{v}_{h}", 60, "_hour")
    joined = lookup(keyed, near, ["_hour", *CELL])

    def pick(var: str, k: int) -> Column:
        cases = " ".join(f"WHEN {h} THEN `_{var}_{h}`" for h in hours)
        return F.expr(f"CASE floor((minute(`{ts}`) + {k * step}) / 60) {cases} END")

    names = [lag_name(v, k) for v in variables for k in offsets]
    cols = {lag_name(v, k): pick(v, k) for v in variables for k in offsets}
    return joined.withColumns(cols).select(*[q(c) for c in df.columns], *[q(n) for n in names])


def asof_backward_lookup(
    df: DataFrame,
    rasters: DataFrame,
    value: str,
    name,
    offsets: Sequence[int] | None = None,
    step: int = 10,
    ts: str = "ts",
) -> DataFrame:
    """Value of the latest raster dated on or before the day of ``ts`` (shifted by
    each offset); days before the first raster use the first one.

    Raster dates and calendar days are both bounded by the time span, so the range
    join runs between two calendars; the data itself only meets equi-joins.
    """
    offsets_list = [0] if offsets is None else list(offsets)
    dates = rasters.select("date").distinct()
    timeline = Window.orderBy("date")
    spans = dates.select(
        F.when(F.row_number().over(timeline) == 1, F.to_date(F.lit("0001-01-01"))).otherwise(F.col("date")).alias("_lo"),
        F.coalesce(F.lead("date").over(timeline), F.to_date(F.lit("9999-12-31"))).alias("_hi"),
        F.col("date").alias("_raster"),
    )
    days = df.select(
        F.explode(F.array_distinct(F.array(*[F.to_date(shift_clock(ts, k, step)) for k in offsets_list]))).alias("_day")
    ).distinct()
    calendar = days.join(F.broadcast(spans), (F.col("_day") >= F.col("_lo")) & (F.col("_day") < F.col("_hi")))
    calendar = calendar.select("_day", "_raster")

    # Per row at most two days differ (offsets span hours); look each up once.
    wanted = df.select(
        *CELL,
        F.explode(F.array_distinct(F.array(*[F.to_date(shift_clock(ts, k, step)) for k in offsets_list]))).alias("_day"),
    ).distinct()
    facts = rasters.select(F.col("date").alias("_raster"), *CELL, q(value).alias("_value"))
    answers = wanted.join(F.broadcast(calendar), "_day").join(facts, ["_raster", *CELL])
    first_day = F.to_date(shift_clock(ts, min(offsets_list), step))
    keyed = df.withColumn("_first", first_day)
    span_days = ((max(offsets_list) - min(offsets_list)) * step) // 1440 + 2
    by_first = answers.select(
        *CELL, F.explode(F.sequence(F.lit(0), F.lit(span_days - 1))).alias("_ahead"), "_day", "_value"
    ).withColumn("_first", F.date_sub("_day", F.col("_ahead")))
    vectors = by_first.groupBy("_first", *CELL).agg(
        *[F.max(F.when(F.col("_ahead") == d, F.col("_value"))).alias(f"_d{d}") for d in range(span_days)]
    )
    joined = lookup(keyed, vectors, ["_first", *CELL])

    def pick(k: int) -> Column:
        ahead = F.datediff(F.to_date(shift_clock(ts, k, step)), F.col("_first"))
        return F.coalesce(*[F.when(ahead == d, F.col(f"_d{d}")) for d in range(span_days)])

    cols = {(name if offsets is None else name(k)): pick(k) for k in offsets_list}
    return joined.withColumns(cols).select(*[q(c) for c in df.columns], *[q(c) for c in cols])


def static_lookup(df: DataFrame, static: DataFrame, name: str = "Dem_value") -> DataFrame:
    """Left join on the cell. No hint: a regional grid is below the broadcast
    threshold and goes out whole, a full-disk one is shuffled."""
    return df.join(static.select(*CELL, F.col("value").alias(name)), list(CELL), "left")


def nearest_station(df: DataFrame, lat: str = "lat", lon: str = "lon", places=STATIONS) -> DataFrame:
    """Name of and distance to the nearest listed place. The list is configuration
    and stays in the expression, so nothing is joined or shuffled."""
    numbered = df.withColumns(unit_vector(lat, lon)).withColumn("_place", nearest_place(places))
    names, lats, lons = (F.array(*[F.lit(p[j]) for p in places]) for j in range(3))
    place = F.col("_place")
    distance = haversine_km(lat, lon, F.element_at(lats, place), F.element_at(lons, place))
    out = numbered.withColumns({"station": F.element_at(names, place), "distance_km": distance})
    return out.drop("_ux", "_uy", "_uz", "_place")


def anti_join_missing(inputs: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(*on), list(on), "left_anti")


def semi_join_known(df: DataFrame, index: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(index.select(*on), list(on), "left_semi")


def calendar(spark, start: str, end: str, step: int = 10) -> DataFrame:
    """Every slot in [start, end). Slots are numbers first, so they are made in
    parallel and not from one exploded array."""
    from cellclock.functions.clock import from_epoch_minutes

    bounds = spark.sql(
        f"SELECT cast(unix_seconds(timestamp '{start}')/60 AS bigint), cast(unix_seconds(timestamp '{end}')/60 AS bigint)"
    ).first()
    return spark.range(bounds[0], bounds[1], step).select(from_epoch_minutes(F.col("id")).alias("ts"))


def availability_calendar(slots: DataFrame, bands: Sequence[str], index: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Status of every (slot, band): ``ok`` under its own name, else ``alias`` when
    the scene is filed under the other band code, else ``absent``."""
    wanted = slots.select("ts", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    other = table[F.col("band")] if aliases else F.lit(None).cast("string")
    known = index.select("ts", "band").distinct()
    by_name = known.select("ts", "band", F.lit(True).alias("_own"))
    by_alias = known.select("ts", F.col("band").alias("_other"), F.lit(True).alias("_alias"))
    joined = wanted.withColumn("_other", other).join(by_name, ["ts", "band"], "left").join(by_alias, ["ts", "_other"], "left")
    status = F.when(F.col("_own"), "ok").when(F.col("_alias"), "alias").otherwise("absent")
    return joined.select("ts", "band", status.alias("status"))


def align_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Put two column sets of the same rows side by side, by key."""
    return left.join(right, list(key))


def rank_join(*tables: DataFrame, on: str = "feature") -> DataFrame:
    """Inner join of rank tables; ``rank`` columns become rank_1, rank_2, …"""
    out = None
    for i, table in enumerate(tables, 1):
        named = table.select(on, F.col("rank").alias(f"rank_{i}"))
        out = named if out is None else out.join(named, on)
    return out
