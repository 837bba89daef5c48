"""Scalers by name, inverse scaling and per-kind normalisation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.names import lag_name, q


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def scale_minmax(x: Column, low, high) -> Column:
    """Guarded form: a range of 0 gives 0.5, a range below 1e-10 is widened by 1e-10."""
    low, width = _lit(low), _lit(high) - _lit(low)
    widened = F.when(width < 1e-10, width + 1e-10).otherwise(width)
    return F.when(width == 0, F.when(x.isNotNull(), 0.5)).otherwise((x - low) / F.nullif(widened, F.lit(0.0)))


def scale_robust(x: Column, q1, q2, q3) -> Column:
    return (x - _lit(q2)) / F.nullif(_lit(q3) - _lit(q1), F.lit(0.0))


def scale_standard(x: Column, mean, std) -> Column:
    return (x - _lit(mean)) / F.nullif(_lit(std), F.lit(0.0))


def scale_log1p(x: Column) -> Column:
    return F.log1p(x)


def scale_by_constant(x: Column, value) -> Column:
    if not isinstance(value, Column) and value == 0:
        raise ValueError("cannot scale by 0")
    return x / F.nullif(_lit(value), F.lit(0.0))


def scale_clip(x: Column, low, high) -> Column:
    """clamp((x-low)/(high-low), 0, 1)"""
    y = (x - _lit(low)) / F.nullif(_lit(high) - _lit(low), F.lit(0.0))
    return F.when(y.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def scale_maxabs_clip(x: Column, max_abs) -> Column:
    """clamp(x/max_abs, -1, 1)"""
    y = x / F.nullif(_lit(max_abs), F.lit(0.0))
    return F.when(y.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)))


# name -> (column function, number of parameters)
SCALERS: dict[str, tuple[Callable[..., Column], int]] = {
    "MinMaxScaler": (scale_minmax, 2),
    "RobustScaler": (scale_robust, 3),
    "StandardScaler": (scale_standard, 2),
    "LogScaler": (scale_log1p, 0),
    "AverageScaler": (scale_by_constant, 1),
    "MaxScaler": (scale_by_constant, 1),
}


def apply_scaler(df: DataFrame, columns: Sequence[str], name: str, params: Sequence[float] = ()) -> DataFrame:
    """Scale ``columns`` by a registered scaler. Unknown names and a wrong number
    of parameters raise."""
    if name not in SCALERS:
        raise KeyError(f"unknown scaler {name!r}; known: {', '.join(SCALERS)}")
    fn, arity = SCALERS[name]
    if len(params) != arity:
        raise ValueError(f"{name} takes {arity} parameter(s), got {len(params)}")
    return df.withColumns({c: fn(q(c), *params) for c in columns})


def inverse_standard(x: Column, mean, std) -> Column:
    return x * _lit(std) + _lit(mean)


def inverse_minmax(x: Column, low, high) -> Column:
    return x * (_lit(high) - _lit(low)) + _lit(low)


def normalized(x: Column, kind: str, low, high) -> Column:
    """``minmax`` ordinary band, ``max`` divided by its maximum, ``maxabs`` divided
    by the larger magnitude of its bounds, ``keep`` untouched."""
    if kind == "keep":
        return x
    if kind == "minmax":
        return (x - _lit(low)) / F.nullif(_lit(high) - _lit(low), F.lit(0.0))
    if kind == "max":
        return x / F.nullif(_lit(high), F.lit(0.0))
    if kind == "maxabs":
        return x / F.nullif(F.greatest(F.abs(_lit(low)), F.abs(_lit(high))), F.lit(0.0))
    raise ValueError(f"unknown kind: {kind}")


def normalize_by_kind(
    df: DataFrame,
    scales: Mapping[str, tuple[float, float]],
    kinds: Mapping[str, str],
    offsets: Sequence[int],
    static: Sequence[str] = (),
) -> DataFrame:
    """Normalise all lags of all bands in one select. Bands without an entry in
    ``scales`` are left alone; the default kind is ``minmax``. ``scales`` is a
    configuration of a few dozen bands."""
    new = {}
    for band, (low, high) in scales.items():
        names = [band] if band in static else [lag_name(band, k) for k in offsets]
        for name in names:
            if name in df.columns:
                new[name] = normalized(q(name), kinds.get(band, "minmax"), low, high)
    return df.withColumns(new)
