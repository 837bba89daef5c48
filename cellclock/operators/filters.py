"""Row predicates. All of them push down or fuse into the scan stage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.grid import Grid
from cellclock.names import FULL, lag_name, q

# The northern window of the study grid and the storm season.
NORTH_ROWS = (8, 119)
NORTH_COLS = (13, 187)
SEASON = (5, 6, 7)

# Brightness-temperature limits of the physical cloud filter.
LAND_I4B_MIN = 223.66
LAND_I4B_B12B_MIN = 1.24
SEA_I4B_MIN = 248.98
SEA_I4B_IRB_MAX = 38.21

MIN_FILE_BYTES = 1000  # fixed value


def cell_window_filter(
    df: DataFrame,
    rows: tuple[int, int] = NORTH_ROWS,
    cols: tuple[int, int] = NORTH_COLS,
    months: Iterable[int] | None = SEASON,
    ts: str = "ts",
) -> DataFrame:
    out = df.where(F.col("row").between(*rows) & F.col("col").between(*cols))
    return out if months is None else out.where(F.month(ts).isin(*months))


def bbox_filter(
    df: DataFrame, lon: tuple[float, float], lat: tuple[float, float], margin: float = 0.5
) -> DataFrame:
    return df.where(
        F.col("lon").between(lon[0] - margin, lon[1] + margin)
        & F.col("lat").between(lat[0] - margin, lat[1] + margin)
    )


def calendar_filter(
    df: DataFrame,
    ts: str = "ts",
    months: Iterable[int] | None = None,
    years: Iterable[int] | None = None,
    night: bool = False,
) -> DataFrame:
    """By month, by year, and for ``night`` the hours from 20 until 5."""
    tests = []
    if months is not None:
        tests.append(F.month(ts).isin(*months))
    if years is not None:
        tests.append(F.year(ts).isin(*years))
    if night:
        tests.append((F.hour(ts) >= 20) | (F.hour(ts) < 5))
    return df.where(reduce(and_, tests)) if tests else df


def negatives_only(df: DataFrame, label: str = "output_0") -> DataFrame:
    return df.where(q(label) == 0) if label in df.columns else df


def every_lag(band: str, test, offsets: Sequence[int] = FULL) -> Column:
    """``test`` holds for each lag of ``band``; a missing lag fails."""
    return F.coalesce(reduce(and_, [test(q(lag_name(band, k))) for k in offsets]), F.lit(False))


def physical_cloud_filter(
    df: DataFrame,
    is_land: Column,
    cold: str = "I4B",
    land_diff: str = "I4B-B12B",
    sea_diff: str = "I4B-IRB",
    land_min: float = LAND_I4B_MIN,
    land_diff_min: float = LAND_I4B_B12B_MIN,
    sea_min: float = SEA_I4B_MIN,
    sea_diff_max: float = SEA_I4B_IRB_MAX,
    offsets: Sequence[int] = FULL,
) -> DataFrame:
    """Keep rows warm enough at every lag, with a difference test that depends on
    the surface."""
    land = is_land & every_lag(cold, lambda c: c >= land_min, offsets)
    land = land & every_lag(land_diff, lambda c: c >= land_diff_min, offsets)
    sea = ~is_land & every_lag(cold, lambda c: c >= sea_min, offsets)
    sea = sea & every_lag(sea_diff, lambda c: c <= sea_diff_max, offsets)
    return df.where(land | sea)


def polarity_class(current: Column, stroke_type: Column) -> Column:
    """pos/neg by the sign of the current, ground/cloud by type 0/1."""
    sign = F.when(current > 0, "pos").when(current < 0, "neg")
    where = F.when(stroke_type == 0, "ground").when(stroke_type == 1, "cloud")
    return F.concat(sign, F.lit("_"), where)


def small_file_filter(files: DataFrame, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    return files.where(F.col("length") >= min_bytes)


def range_filter(df: DataFrame, column: str, low, high, half_open: bool = False) -> DataFrame:
    c = q(column)
    return df.where((c >= low) & (c < high)) if half_open else df.where(c.between(low, high))
