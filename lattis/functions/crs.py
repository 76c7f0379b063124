"""Map projections as Column expressions (Snyder, USGS Professional Paper 1395). All are forward and inverse.

Supported: EPSG 4326 and 4269 (degrees), 3857, 326zz and 327zz (UTM), 6933 (cylindrical equal area) and "conus-albers".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WGS84, NAD83, WEB_MERCATOR, WORLD_CEA, CONUS_ALBERS = 4326, 4269, 3857, 6933, "conus-albers"
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
#: CONUS Albers: standard parallels, origin.
_ALBERS = (29.5, 45.5, 23.0, -96.0)


def is_metric(crs) -> bool:
    return crs not in (WGS84, NAD83, None)


def utm_epsg_for(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + min(max(int((lon + 180) // 6) + 1, 1), 60)


def suggest_metric_crs(minx: float, miny: float, maxx: float, maxy: float):
    """UTM of the centre for extents of up to 6 by 6 degrees, CONUS Albers inside its area, else the world's equal area."""
    if maxx - minx <= 6 and maxy - miny <= 6:
        return utm_epsg_for((minx + maxx) / 2, (miny + maxy) / 2)
    if minx >= -130 and maxx <= -60 and miny >= 20 and maxy <= 55:
        return CONUS_ALBERS
    return WORLD_CEA


def _q(phi):
    """Snyder 3-12, for floats or Columns."""
    sin, log = (F.sin, F.log) if isinstance(phi, Column) else (math.sin, math.log)
    s = sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - E * s) / (1 + E * s)) / (2 * E))


def _phi_from_q(q: Column) -> Column:
    """The latitude of an authalic value, by the series 3-18."""
    qp = _q(math.pi / 2)
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    e4, e6 = E2**2, E2**3
    return b + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + 761 * e6 / 45360 * F.sin(6 * b)


def _utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    ep2 = E2 / (1 - E2)
    s, c = F.sin(phi), F.cos(phi)
    n = A / F.sqrt(1 - E2 * s * s)
    t, cc, a = F.tan(phi) * F.tan(phi), ep2 * c * c, c * lam
    x = 0.9996 * n * (a + (1 - t + cc) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * F.pow(a, 5) / 120) + 500000
    y = 0.9996 * (_arc(phi) + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * F.pow(a, 6) / 720))
    return x, y + (10_000_000 if south else 0)


def _arc(phi: Column) -> Column:
    e4, e6 = E2**2, E2**3
    return A * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - 35 * e6 / 3072 * F.sin(6 * phi)
    )


def _utm_inverse(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    ep2, e4, e6 = E2 / (1 - E2), E2**2, E2**3
    mu = (y - (10_000_000 if south else 0)) / 0.9996 / (A * (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    cc, n = ep2 * c * c, A / F.sqrt(1 - E2 * s * s)
    r = A * (1 - E2) / F.pow(1 - E2 * s * s, 1.5)
    d = (x - 500000) / (n * 0.9996)
    lat = phi - (n * F.tan(phi) / r) * (d * d / 2 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * ep2 - 3 * cc * cc) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + cc) * F.pow(d, 3) / 6 + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / c
    return F.degrees(lon) + (6 * zone - 183), F.degrees(lat)


def _albers() -> tuple[float, float, float]:
    p1, p2, p0 = (math.radians(v) for v in _ALBERS[:3])
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    n = (m(p1) ** 2 - m(p2) ** 2) / (_q(p2) - _q(p1))
    c = m(p1) ** 2 + n * _q(p1)
    return n, c, A * math.sqrt(c - n * _q(p0)) / n


def forward(lon: Column, lat: Column, crs) -> tuple[Column, Column]:
    """Degrees to x and y in crs."""
    if not is_metric(crs):
        return lon, lat
    if crs == WEB_MERCATOR:
        return F.radians(lon) * A, A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    if crs == WORLD_CEA:
        k0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
        return F.radians(lon) * (A * k0), _q(F.radians(lat)) * (A / (2 * k0))
    if crs == CONUS_ALBERS:
        n, c, rho0 = _albers()
        rho, theta = A * F.sqrt(c - n * _q(F.radians(lat))) / n, n * F.radians(lon - _ALBERS[3])
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)
    if 32601 <= crs <= 32660 or 32701 <= crs <= 32760:
        return _utm(lon, lat, crs % 100, crs >= 32700)
    raise ValueError(f"unsupported crs {crs}")


def inverse(x: Column, y: Column, crs) -> tuple[Column, Column]:
    """x and y in crs to degrees."""
    if not is_metric(crs):
        return x, y
    if crs == WEB_MERCATOR:
        return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)
    if crs == WORLD_CEA:
        k0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
        return F.degrees(x / (A * k0)), F.degrees(_phi_from_q(y * (2 * k0 / A)))
    if crs == CONUS_ALBERS:
        n, c, rho0 = _albers()
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        return F.degrees(F.atan2(x, rho0 - y) / n) + _ALBERS[3], F.degrees(_phi_from_q((c - rho * rho * (n * n / A**2)) / n))
    if 32601 <= crs <= 32660 or 32701 <= crs <= 32760:
        return _utm_inverse(x, y, crs % 100, crs >= 32700)
    raise ValueError(f"unsupported crs {crs}")


def reproject(df: DataFrame, x: str, y: str, source, target, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with the columns out: x and y of source in target. A missing source counts as degrees."""
    lon, lat = inverse(F.col(x), F.col(y), source if source is not None else WGS84)
    ox, oy = forward(lon, lat, target)
    return df.withColumns({out[0]: ox, out[1]: oy})
