"""Missing values: sentinels and non-finite numbers become what was asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.names import lag_name, q

SENTINEL = -9999.0  # fixed value


def nonfinite_to_null(col: Column) -> Column:
    infinite = (col == F.lit(float("inf"))) | (col == F.lit(float("-inf")))
    return F.when(~(F.isnan(col) | infinite), col)


def sentinel_to(col: Column, sentinel: float = SENTINEL, value: float | None = None) -> Column:
    return F.when(col == F.lit(sentinel), F.lit(value)).otherwise(col)


def _lags(band: str, offsets: Sequence[int] | None) -> list[str]:
    return [band] if offsets is None else [lag_name(band, k) for k in offsets]


def replace_sentinel(
    df: DataFrame, band: str, sentinel: float, value: float | None, offsets: Sequence[int] | None = None
) -> DataFrame:
    """Replace ``sentinel`` in one column, or in every lag of a band."""
    return df.withColumns({c: sentinel_to(q(c), sentinel, value) for c in _lags(band, offsets)})


def sentinel_with_mask(
    df: DataFrame,
    band: str,
    sentinel: float,
    value: float | None,
    flag: str,
    offsets: Sequence[int] | None = None,
) -> DataFrame:
    """As :func:`replace_sentinel`, plus a flag per column: 1 valid, 0 sentinel."""
    new: dict[str, Column] = {}
    for source, target in zip(_lags(band, offsets), _lags(flag, offsets)):
        hit = q(source).eqNullSafe(F.lit(sentinel))
        new[target] = F.when(hit, F.lit(0)).otherwise(F.lit(1)).cast("tinyint")
        new[source] = sentinel_to(q(source), sentinel, value)
    return df.withColumns(new)


def clear_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: nonfinite_to_null(q(c)) for c in columns})


def normalize_missing(df: DataFrame, columns: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    """The read rule: NaN, infinities and the sentinel are all NULL afterwards."""
    return df.withColumns({c: sentinel_to(nonfinite_to_null(q(c)), sentinel, None) for c in columns})


def fill_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(q(c), F.lit(v)) for c, v in defaults.items()})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows missing (NULL or NaN) in any listed column that exists."""
    present = [c for c in columns if c in df.columns]
    return df.na.drop(subset=present) if present else df


def cast_columns(
    df: DataFrame, columns: Sequence[str] | Mapping[str, str], dtype: str | None = None, strict: bool = True
) -> DataFrame:
    """One type for a list, or a type per column; ``strict=False`` turns text that
    is no number into NULL instead of failing."""
    types = {c: dtype for c in columns} if dtype else dict(columns)
    return df.withColumns({c: q(c).cast(t) if strict else q(c).try_cast(t) for c, t in types.items()})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
