"""Regular lon/lat grids and the affine arithmetic on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """North-up grid: ``lon0``/``lat0`` is the outer corner of cell (0, 0)."""

    lon0: float
    lat0: float
    dx: float
    dy: float
    height: int
    width: int

    def cell(self, lon: Column | str, lat: Column | str, rounding: str = "floor") -> tuple[Column, Column]:
        """(row, col) of a point. ``truncate`` sends a point just outside the
        west/north edge to cell 0, ``floor`` sends it to -1."""
        lon, lat = _c(lon), _c(lat)
        x = (lon - F.lit(self.lon0)) / F.lit(self.dx)
        y = (F.lit(self.lat0) - lat) / F.lit(self.dy)
        if rounding == "floor":
            return F.floor(y).cast("int"), F.floor(x).cast("int")
        if rounding == "truncate":
            return y.cast("int"), x.cast("int")
        raise ValueError(f"unknown rounding: {rounding}")

    def center(self, row: Column | str, col: Column | str) -> tuple[Column, Column]:
        """(lon, lat) of a cell centre."""
        row, col = _c(row), _c(col)
        lon = F.lit(self.lon0) + (col + F.lit(0.5)) * F.lit(self.dx)
        lat = F.lit(self.lat0) - (row + F.lit(0.5)) * F.lit(self.dy)
        return lon, lat

    def contains(self, row: Column | str, col: Column | str) -> Column:
        row, col = _c(row), _c(col)
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)


# The study region at 0.04 degrees.
REGION = Grid(lon0=101.0, lat0=24.0, dx=0.04, dy=0.04, height=438, width=250)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
