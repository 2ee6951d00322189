"""Column expressions on the sphere and on grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean earth radius in metres.
EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def web_mercator(lat: Column, lon: Column, clip: bool = True) -> tuple[Column, Column]:
    """x and y in metres; latitudes are clipped to the projection's square, or go into the formula as they are (y is NaN where its logarithm has no value)."""
    radius, edge = 6_378_137.0, 85.05112878
    if clip:
        lat = F.greatest(F.least(lat, F.lit(edge)), F.lit(-edge))
    t = F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)
    log = F.when(t > 0, F.log(t)).when(t == 0, F.lit(float("-inf"))).when(t.isNotNull(), F.lit(float("nan")))
    return F.radians(lon) * radius, log * radius


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def utm_xy(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (WGS 84) by the Krueger series of third order; southern rows get the false northing."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = 0.9996 * radius
    return 500_000 + scale * east, scale * north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def block_of(cell: Column, size: int = 5) -> Column:
    """Block of a cell coordinate; rounds down for negative ones too."""
    return F.floor(cell / F.lit(size)).cast("long")


def circular_distance(a: Column, b: Column, period: float = 360.0) -> Column:
    d = F.abs(F.pmod(a - b, F.lit(period)))
    return F.least(d, period - d)


def local_cell(lat: Column, lon: Column, middle: Column, size: float = 1000.0) -> tuple[Column, Column]:
    """East and north cell of a local equirectangular grid; `middle` is the latitude whose cosine (0.01 at least) scales longitudes."""
    scale = F.greatest(F.cos(F.radians(middle)), F.lit(0.01))
    return F.floor(F.radians(lon) * EARTH_M * scale / size).cast("long"), F.floor(F.radians(lat) * EARTH_M / size).cast("long")
