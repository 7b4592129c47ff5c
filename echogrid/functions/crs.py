"""Geographic and UTM coordinates on WGS 84, by the Krueger series, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import projections

A, INV_F, K0, FALSE_E, FALSE_N = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
_F = 1 / INV_F
_N = _F / (2 - _F)
_E = (_F * (2 - _F)) ** 0.5
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def zone_of(crs: str) -> tuple[int, bool] | None:
    """(zone, south) of epsg:326zz or epsg:327zz; None for epsg:4326."""
    code = re.fullmatch(r"(?i)epsg:(\d+)", crs.strip())
    n = int(code[1]) if code else 0
    if n == 4326:
        return None
    if n // 100 in (326, 327) and 1 <= n % 100 <= 60:
        return n % 100, n // 100 == 327
    raise ValueError(f"{crs!r} is neither epsg:4326 nor a UTM zone on WGS 84")


def to_utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Degrees to easting and northing."""
    d, phi = F.radians(lon - F.lit(float(6 * zone - 183))), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_E) + F.lit(K0 * RADIUS) * x, F.lit(FALSE_N if south else 0.0) + F.lit(K0 * RADIUS) * y


def from_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing to degrees."""
    xi, eta = (y - F.lit(FALSE_N if south else 0.0)) / F.lit(K0 * RADIUS), (x - F.lit(FALSE_E)) / F.lit(K0 * RADIUS)
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, c in enumerate(DELTA, 1):
        phi = phi + F.lit(c) * F.sin(2 * j * chi)
    return F.lit(float(6 * zone - 183)) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def transform(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    """x, y (longitude, latitude for geographic systems) from one system to the other: codes, proj strings or WKT."""
    try:
        a, b = zone_of(src), zone_of(dst)
    except ValueError:
        return projections.transform(x, y, src, dst)
    if a == b:
        return x, y
    lon, lat = (x, y) if a is None else from_utm(x, y, *a)
    return (lon, lat) if b is None else to_utm(lon, lat, *b)
