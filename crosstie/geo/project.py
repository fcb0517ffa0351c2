"""Transverse Mercator projection as column expressions.

Series of Snyder, "Map Projections: A Working Manual" (USGS PP 1395), section 8.
Every ellipsoid and grid parameter is an argument, so any transverse Mercator
grid can be used; ``TM_92W30`` holds the metre grid used by the study.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosstie.functions.nulls import col


@dataclass(frozen=True)
class TransverseMercator:
    a: float
    inv_f: float
    lat0: float
    lon0: float
    k0: float
    false_easting: float
    false_northing: float

    @property
    def e2(self) -> float:
        f = 1.0 / self.inv_f if self.inv_f else 0.0
        return f * (2.0 - f)

    def meridian_terms(self) -> tuple[float, float, float, float]:
        """Coefficients of phi, sin 2phi, sin 4phi, sin 6phi in the meridian arc."""
        e2 = self.e2
        e4, e6 = e2 ** 2, e2 ** 3
        return (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256,
                -(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024),
                15 * e4 / 256 + 45 * e6 / 1024,
                -35 * e6 / 3072)

    def arc_at_origin(self) -> float:
        phi = math.radians(self.lat0)
        c = self.meridian_terms()
        return self.a * (c[0] * phi + sum(c[i] * math.sin(2 * i * phi) for i in (1, 2, 3)))


# GRS80 ellipsoid, transverse Mercator grid in metres centred on 92.5 W.
TM_92W30 = TransverseMercator(
    a=6378137.0, inv_f=298.257222101, lat0=35.0 + 50.0 / 60.0, lon0=-92.5,
    k0=0.9999333333, false_easting=500000.0, false_northing=0.0)


def project(lon: str | Column, lat: str | Column, grid: TransverseMercator = TM_92W30) -> tuple[Column, Column]:
    """Degrees to grid metres: ``(x, y)``."""
    e2 = grid.e2
    ep2 = e2 / (1 - e2)
    c = grid.meridian_terms()
    phi = F.radians(col(lat))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(grid.a) / F.sqrt(1 - e2 * sin * sin)
    t = tan * tan
    cc = ep2 * cos * cos
    a = cos * F.radians(col(lon) - F.lit(grid.lon0))
    m = grid.a * (c[0] * phi + c[1] * F.sin(2 * phi) + c[2] * F.sin(4 * phi) + c[3] * F.sin(6 * phi))
    a2 = a * a
    x = n * a * (1 + a2 * ((1 - t + cc) / 6 + a2 * (5 - 18 * t + t * t + 72 * cc - 58 * ep2) / 120))
    y = m - grid.arc_at_origin() + n * tan * a2 * (
        0.5 + a2 * ((5 - t + 9 * cc + 4 * cc * cc) / 24
                    + a2 * (61 - 58 * t + t * t + 600 * cc - 330 * ep2) / 720))
    return grid.false_easting + grid.k0 * x, grid.false_northing + grid.k0 * y


def unproject(x: str | Column, y: str | Column, grid: TransverseMercator = TM_92W30) -> tuple[Column, Column]:
    """Grid metres to degrees: ``(lon, lat)``."""
    e2 = grid.e2
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    m = grid.arc_at_origin() + (col(y) - F.lit(grid.false_northing)) / grid.k0
    mu = m / (grid.a * grid.meridian_terms()[0])
    foot = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(2 * mu)
            + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * F.sin(6 * mu) + (1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    w = 1 - e2 * sin * sin
    n = F.lit(grid.a) / F.sqrt(w)
    r = F.lit(grid.a * (1 - e2)) / (w * F.sqrt(w))
    t = tan * tan
    c = ep2 * cos * cos
    d = (col(x) - F.lit(grid.false_easting)) / (n * grid.k0)
    d2 = d * d
    lat = foot - (n * tan / r) * d2 * (
        0.5 - d2 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) / 24
                    - d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) / 720))
    lon = d * (1 - d2 * ((1 + 2 * t + c) / 6
                         - d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) / 120)) / cos
    return grid.lon0 + F.degrees(lon), F.degrees(lat)
