"""Column naming: ``BAND_t-6 … BAND_t+5`` and the spellings that map to it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY = tuple(range(-6, 0))
FULL = tuple(range(-6, 6))
HORIZONS = 6

# Older band codes and the names used everywhere else.
BAND_ALIASES = {
    "N1B": "B04B",
    "N2B": "B05B",
    "N3B": "B06B",
    "W2B": "B09B",
    "W3B": "B10B",
    "MIB": "B11B",
    "O3B": "B12B",
    "L2B": "B14B",
    "COB": "B16B",
    "albedo_03": "VSB",
    "albedo_04": "B04B",
    "albedo_05": "B05B",
    "albedo_06": "B06B",
    "tbb_07": "I4B",
    "tbb_08": "WVB",
    "tbb_09": "B09B",
    "tbb_10": "B10B",
    "tbb_11": "B11B",
    "tbb_12": "B12B",
    "tbb_13": "IRB",
    "tbb_14": "B14B",
    "tbb_15": "I2B",
    "tbb_16": "B16B",
}

# Bands whose pairwise differences are candidate features.
INFRARED_BANDS = ("B09B", "B10B", "B11B", "B12B", "B14B", "B16B", "I2B", "I4B", "IRB", "WVB")


def lag_name(band: str, offset: int) -> str:
    return f"{band}_t{offset:+d}"


def lag_columns(
    bands: Iterable[str],
    offsets: Sequence[int] = HISTORY,
    static: Sequence[str] = (),
    time_major: bool = False,
) -> list[str]:
    """Names of all lags; bands in ``static`` have one column and no lag suffix."""

    def one(band: str, k: int) -> str:
        return band if band in static else lag_name(band, k)

    bands = list(bands)
    if time_major:
        names = [one(b, k) for k in offsets for b in bands]
    else:
        names = [one(b, k) for b in bands for k in offsets]
    return list(dict.fromkeys(names))


def archive_name(band: str) -> str:
    """The name that archive files give a band, or the band itself."""
    found = [old for old, new in BAND_ALIASES.items() if new == band and "_" in old]
    return found[0] if found else band


def canonical_name(name: str, minutes_per_step: int = 10) -> str:
    """``B(10)`` and ``B_10p`` (minutes back) and old band codes -> ``B_t-1``."""
    found = re.fullmatch(r"(.+?)(?:\((\d+)\)|_(\d+)p|_t([+-]\d+))", name)
    if not found:
        return BAND_ALIASES.get(name, name)
    band, paren, back, lag = found.groups()
    band = BAND_ALIASES.get(band, band)
    if lag is not None:
        return lag_name(band, int(lag))
    return lag_name(band, -(int(paren or back) // minutes_per_step))


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by ``mapping``, or bring every spelling to the canonical one."""
    if mapping is None:
        mapping = {c: canonical_name(c) for c in df.columns}
    return df.withColumnsRenamed(mapping)


def band_alias(col: Column | str) -> Column:
    """The same alias table for a band *value* in a long table."""
    col = F.col(col) if isinstance(col, str) else col
    table = F.create_map(*[F.lit(x) for pair in BAND_ALIASES.items() for x in pair])
    return F.coalesce(table[col], col)


def all_band_pairs(bands: Sequence[str] = INFRARED_BANDS) -> list[str]:
    """Every unordered pair as ``A-B``, in list order."""
    return [f"{a}-{b}" for a, b in combinations(bands, 2)]


def q(name: str) -> Column:
    """A column by exact name (lag names hold ``+`` and ``-``)."""
    return F.col(f"`{name}`")
