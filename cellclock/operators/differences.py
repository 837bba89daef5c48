"""Columns derived from pairs of bands, and scalers fitted on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellclock.functions.scaling import scale_standard
from cellclock.names import FULL, lag_name, q


def band_difference(df: DataFrame, pairs: Sequence[str], offsets: Sequence[int] = FULL) -> DataFrame:
    """``A-B_t±k = A_t±k - B_t±k``, all in one projection. Names that are no pair
    and pairs with an absent side are skipped."""
    have = set(df.columns)
    new = {}
    for pair in pairs:
        sides = pair.strip().split("-")
        if len(sides) != 2:
            continue
        for k in offsets:
            left, right = (lag_name(side, k) for side in sides)
            if left in have and right in have:
                new[lag_name(f"{sides[0]}-{sides[1]}", k)] = q(left) - q(right)
    return df.withColumns(new)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise each column (each time step of a band on its own) with its own
    mean and population standard deviation. The statistics are a
    scalar subquery of one row."""
    fit = df.agg(
        F.struct(
            *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        )
    ).scalar()
    new = {c: scale_standard(q(c), fit.getField(f"m{i}"), fit.getField(f"s{i}")) for i, c in enumerate(columns)}
    return df.withColumns(new)
