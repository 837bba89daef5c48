"""Distances on the globe and small fixed point lists."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371  # fixed value

# Weather stations as (name, latitude, longitude).
STATIONS = (
    ("Lao Cai", 22.5007, 103.968872),
    ("Viet Tri", 21.325395, 105.403193),
    ("Son La", 21.332236, 103.905399),
    ("Cao Bang", 22.666667, 106.25),
    ("Phu Lien", 20.794468, 106.61402),
    ("Ha Dong", 20.955764, 105.753945),
    ("Thanh Hoa", 19.761764, 105.778221),
    ("Tuong Duong", 19.265, 104.47),
    ("Vinh", 18.675, 105.691),
    ("Dong Hoi", 17.483333, 106.6),
    ("Da Nang", 16.04316, 108.206642),
    ("Quy Nhon", 13.765258, 109.226201),
    ("Nha Trang", 12.217986, 109.204996),
    ("Phan Thiet", 10.933333, 108.1),
    ("Pleiku", 13.966667, 108.016667),
    ("Chau Doc", 10.7, 105.133333),
    ("Ca Mau", 9.183333, 105.150008),
    ("Nha Be", 10.638, 106.734),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1) / 2)
    half_lon = F.sin((lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def unit_vector(lat: Column | str, lon: Column | str) -> dict[str, Column]:
    """The point on the unit sphere, as columns _ux, _uy, _uz."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return {"_ux": F.cos(la) * F.cos(lo), "_uy": F.cos(la) * F.sin(lo), "_uz": F.sin(la)}


def nearest_place(places=STATIONS) -> Column:
    """1-based number of the place nearest to (_ux, _uy, _uz), the first on a tie.

    Candidates are compared by the straight chord, which orders points as the great
    circle does but needs no trigonometric call per candidate.
    """
    ranks = []
    for i, (_, lat, lon) in enumerate(places, 1):
        la, lo = math.radians(lat), math.radians(lon)
        x, y, z = math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)
        d2 = " + ".join(f"({u} - {v!r}D) * ({u} - {v!r}D)" for u, v in (("_ux", x), ("_uy", y), ("_uz", z)))
        ranks.append(f"struct({d2} AS chord, {i} AS ord)")
    return F.expr(f"array_min(array({', '.join(ranks)})).ord")
