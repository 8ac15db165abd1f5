"""Map projections as column expressions: longitude and latitude in degrees to metres (or the ellipsoid's unit) on a plane."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the longer axis and the inverse flattening.
GRS80 = (6378137.0, 298.257222101)
#: Where a point lies, as (x, y).
Projection = Callable[[Column, Column], tuple[Column, Column]]


def transverse_mercator(central: float, origin: float = 0.0, scale: float = 0.9996, east: float = 500_000.0, north: float = 0.0, ellipsoid: tuple[float, float] = GRS80) -> Projection:
    """Krüger's series to the third power of the third flattening: under a millimetre within some degrees of the meridian."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    t0 = math.sinh(math.atanh(math.sin(math.radians(origin))) - e * math.atanh(e * math.sin(math.radians(origin))))
    start = math.atan(t0)
    start += sum(c * math.sin(2 * j * start) for j, c in enumerate(series, 1))

    def project(lon: Column, lat: Column) -> tuple[Column, Column]:
        s, away = F.sin(F.radians(lat)), F.radians(lon - central)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, c in enumerate(series, 1):
            x, y = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return east + scale * radius * x, north + scale * radius * (y - start)

    return project


def conformal_conic(central: float, origin: float, first: float, second: float, east: float, north: float, ellipsoid: tuple[float, float] = GRS80) -> Projection:
    """Lambert's cone through two parallels."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    e = math.sqrt(f * (2 - f))

    def narrowing(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def height(lat: float) -> float:
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)

    p0, p1, p2 = map(math.radians, (origin, first, second))
    n = math.log(narrowing(p1) / narrowing(p2)) / math.log(height(p1) / height(p2))
    size = a * narrowing(p1) / (n * height(p1) ** n)
    top = size * height(p0) ** n

    def project(lon: Column, lat: Column) -> tuple[Column, Column]:
        phi = F.radians(lat)
        s = e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
        r, turn = size * F.pow(t, F.lit(n)), n * F.radians(lon - central)
        return east + r * F.sin(turn), north + top - r * F.cos(turn)

    return project


#: The planes that district layers of two states are drawn on.
UTM_15 = transverse_mercator(-93.0)
TEXAS_CONIC = conformal_conic(-100.0, 31 + 10 / 60, 27 + 25 / 60, 34 + 55 / 60, 1_000_000.0, 1_000_000.0)
