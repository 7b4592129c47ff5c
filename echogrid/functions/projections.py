"""Map projections and datum shifts as column expressions, chosen by a code, a proj string or WKT.

Geographic coordinates are longitude and latitude in degrees. A system is an
ellipsoid, a projection, and the seven parameters that lead to WGS 84.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import arrays

# Semi-major axis and inverse flattening of ellipsoids.
ELLIPSOIDS = {
    "wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "wgs72": (6378135.0, 298.26), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128),
    "airy": (6377563.396, 299.3249646), "krass": (6378245.0, 298.3), "clrk66": (6378206.4, 294.978698213898), "clrk80": (6378249.145, 293.465), "sphere": (6370997.0, math.inf),
}
#: Systems by their EPSG code, beside the UTM zones.
CODES = {
    4326: "+proj=longlat +ellps=WGS84", 4258: "+proj=longlat +ellps=GRS80", 4269: "+proj=longlat +ellps=GRS80", 4322: "+proj=longlat +ellps=WGS72 +towgs84=0,0,4.5,0,0,0.554,0.219",
    3857: "+proj=merc +a=6378137 +sphere +lon_0=0 +x_0=0 +y_0=0", 3395: "+proj=merc +ellps=WGS84 +lon_0=0 +k=1",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +ellps=WGS84", 3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +ellps=WGS84", 3995: "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0 +ellps=WGS84", 3032: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +ellps=WGS84",
    32661: "+proj=stere +lat_0=90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +ellps=WGS84", 32761: "+proj=stere +lat_0=-90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +ellps=WGS84",
    2193: "+proj=tmerc +lat_0=0 +lon_0=173 +k=0.9996 +x_0=1600000 +y_0=10000000 +ellps=GRS80", 27700: "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489",
    2154: "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80", 3034: "+proj=lcc +lat_1=35 +lat_2=65 +lat_0=52 +lon_0=10 +x_0=4000000 +y_0=2800000 +ellps=GRS80", 3851: "+proj=lcc +lat_1=-37.5 +lat_2=-44.5 +lat_0=-41 +lon_0=173 +x_0=3000000 +y_0=7000000 +ellps=GRS80",
}
_SECOND = math.pi / 648000


@dataclass(frozen=True)
class System:
    kind: str  # longlat, tmerc, merc, lcc or stere
    a: float
    inverse_f: float
    at: dict = field(default_factory=dict)
    shift: tuple = ()  # dx, dy, dz in m, rx, ry, rz in seconds of arc (position vector), scale in ppm
    unit: float = 1.0  # metres

    @property
    def e2(self) -> float:
        f = 0.0 if math.isinf(self.inverse_f) else 1 / self.inverse_f
        return f * (2 - f)

    def value(self, name: str, default: float = 0.0) -> float:
        return float(self.at.get(name, default))


def parse(text: str) -> System:
    """A system from epsg:code, a proj string or WKT (version 1); one that isn't known raises a ValueError."""
    text = text.strip()
    code = re.fullmatch(r"(?i)(?:epsg:)?(\d+)", text)
    if code:
        n = int(code[1])
        if n // 100 in (326, 327) and 1 <= n % 100 <= 60:
            return parse(f"+proj=utm +zone={n % 100} {'+south' if n // 100 == 327 else ''} +ellps=WGS84")
        if n // 100 == 258 and 28 <= n % 100 <= 38:
            return parse(f"+proj=utm +zone={n % 100} +ellps=GRS80")
        if n not in CODES:
            raise ValueError(f"no system is known by the code {n}; give a proj string or WKT")
        return parse(CODES[n])
    if "[" in text:
        return _wkt(text)
    d = dict(p.lstrip("+").partition("=")[::2] for p in text.split() if p.startswith("+"))
    kind = d.get("proj", "")
    if kind == "utm":
        d |= {"lon_0": 6 * int(d["zone"]) - 183, "k": 0.9996, "x_0": 500000, "y_0": 10000000 if "south" in d else 0}
        kind = "tmerc"
    kind = {"latlong": "longlat", "latlon": "longlat"}.get(kind, kind)
    if kind not in ("longlat", "tmerc", "merc", "lcc", "stere"):
        raise ValueError(f"projection {kind!r} is none of longlat, utm, tmerc, merc, lcc, stere")
    name = d.get("ellps", {"NAD83": "grs80", "WGS84": "wgs84"}.get(d.get("datum", "WGS84"), "wgs84")).lower()
    if name not in ELLIPSOIDS:
        raise ValueError(f"ellipsoid {name!r} is none of {', '.join(ELLIPSOIDS)}")
    a, rf = ELLIPSOIDS[name]
    a = float(d.get("a", a))
    if "rf" in d:
        rf = float(d["rf"])
    if "b" in d:
        rf = math.inf if float(d["b"]) == a else a / (a - float(d["b"]))
    if "sphere" in d:
        d["e"] = 0
    unit = float(d.get("to_meter", {"us-ft": 1200 / 3937, "ft": 0.3048}.get(d.get("units", "m"), 1.0)))
    shift = tuple(float(v) for v in d["towgs84"].split(",")) if d.get("towgs84") else ()
    return _checked(System(kind, a, rf, {k: float(v) for k, v in d.items() if re.fullmatch(r"-?[\d.]+(e-?\d+)?", str(v))}, shift, unit))


def _checked(s: System) -> System:
    if s.kind == "stere" and abs(s.value("lat_0")) != 90:
        raise ValueError("stereographic projections are polar ones here")
    if s.kind == "lcc" and "lat_1" not in s.at and "lat_0" not in s.at:
        raise ValueError("a conic projection needs a latitude")
    if len(s.shift) not in (0, 3, 7):
        raise ValueError("a shift to WGS 84 has three or seven parameters")
    return s


# Names of projections and parameters in WKT.
_WKT_KINDS = {"transverse_mercator": "tmerc", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator": "merc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic": "lcc", "polar_stereographic": "stere"}
_WKT_NAMES = {"latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "central_meridian": "lon_0", "longitude_of_center": "lon_0", "straight_vertical_longitude_from_pole": "lon_0", "scale_factor": "k", "false_easting": "x_0", "false_northing": "y_0", "standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2"}


def _wkt(text: str) -> System:
    ellipsoid = re.search(r'(?i)SPHEROID\[\s*"[^"]*"\s*,\s*([-\d.eE+]+)\s*,\s*([-\d.eE+]+)', text)
    if not ellipsoid:
        raise ValueError("WKT without a spheroid")
    a, rf = float(ellipsoid[1]), float(ellipsoid[2]) or math.inf
    shift = re.search(r"(?i)TOWGS84\[([^\]]*)\]", text)
    shift = tuple(float(v) for v in shift[1].split(",")) if shift else ()
    projection = re.search(r'(?i)PROJECTION\[\s*"([^"]*)"', text)
    if not projection:
        return _checked(System("longlat", a, rf, {}, shift))
    kind = _WKT_KINDS.get(projection[1].lower().replace(" ", "_"))
    if not kind:
        raise ValueError(f"projection {projection[1]!r} is none of {', '.join(_WKT_KINDS)}")
    at = {_WKT_NAMES.get(n.lower().replace(" ", "_"), n.lower()): float(v) for n, v in re.findall(r'(?i)PARAMETER\[\s*"([^"]*)"\s*,\s*([-\d.eE+]+)', text)}
    if kind == "merc" and "lat_1" in at:
        at["lat_ts"] = at["lat_1"]
    if kind == "stere":  # the latitude of origin is that of true scale
        origin = at.get("lat_0", 90.0)
        at["lat_0"] = math.copysign(90.0, origin)
        if abs(origin) != 90:
            at["lat_ts"] = origin
    geographic = re.search(r"(?i)GEOGCS\[", text)
    units = [float(v) for v in re.findall(r'(?i)UNIT\[\s*"[^"]*"\s*,\s*([-\d.eE+]+)', text[: geographic.start()] + text[text.rfind("PROJECTION") :] if geographic else text)]
    unit = units[-1] if units else 1.0
    return _checked(System(kind, a, rf, {k: v * (unit if k in ("x_0", "y_0") else 1) for k, v in at.items()}, shift, unit))


def _e2(s: System) -> float:
    return 0.0 if s.at.get("e") == 0 else s.e2


def _m(phi: float, e2: float) -> float:
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _t(phi: float, e2: float) -> float:
    e = math.sqrt(e2)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)


# Where a formula takes F, that is Spark's functions on columns or kernels.arrays, the same names on NumPy arrays.


def _named(F, **values):
    """Values by name: a struct of columns, or a dict of arrays."""
    return values if F is arrays else F.struct(*[v.alias(k) for k, v in values.items()])


def _let(value: Column, body, F=F) -> Column:
    """body(value) with the value named once: a formula that uses it five times, in one that does too, would be written out 25 times."""
    return F.transform(F.array(value), body)[0]


def _t_of(phi: Column, e2: float, F=F) -> Column:
    e, s = math.sqrt(e2), F.sin(phi)
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - F.lit(e) * s) / (1 + F.lit(e) * s), F.lit(e / 2))


def _latitude(chi: Column, e2: float, F=F) -> Column:
    """From the conformal latitude, by its series."""
    e4, e6, e8 = e2**2, e2**3, e2**4
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    return _let(chi, lambda c: sum((F.lit(v) * F.sin(2 * k * c) for k, v in enumerate(terms, 1)), c), F)


def _krueger(e2: float) -> tuple[float, tuple, tuple]:
    """Rectifying radius by the semi-major axis, and the series there and back."""
    f = 1 - math.sqrt(1 - e2)
    n = f / (2 - f)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)
    return (1 + n**2 / 4 + n**4 / 64) / (1 + n), alpha, beta


def _conic(s: System) -> tuple[float, float, float]:
    """Exponent, scale and radius at the origin of a conic projection."""
    e2 = _e2(s)
    one = math.radians(s.value("lat_1", s.value("lat_0")))
    two = math.radians(s.value("lat_2", math.degrees(one)))
    origin = math.radians(s.value("lat_0", math.degrees(one)))
    n = math.sin(one) if abs(one - two) < 1e-12 else math.log(_m(one, e2) / _m(two, e2)) / math.log(_t(one, e2) / _t(two, e2))
    scale = s.a * s.value("k", s.value("k_0", 1.0)) * _m(one, e2) / (n * _t(one, e2) ** n)
    return n, scale, scale * _t(origin, e2) ** n if abs(origin) < math.pi / 2 or n * origin < 0 else 0.0


def _polar(s: System) -> float:
    """Metres of radius for each unit of t."""
    e2 = _e2(s)
    if "lat_ts" in s.at and abs(s.value("lat_ts")) != 90:
        ts = math.radians(abs(s.value("lat_ts")))
        return s.a * _m(ts, e2) / _t(ts, e2)
    e = math.sqrt(e2)
    return 2 * s.a * s.value("k", s.value("k_0", 1.0)) / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _origin(s: System) -> float:
    """The northing of a transverse Mercator's latitude of origin, before the false northing."""
    phi, e = math.radians(s.value("lat_0")), math.sqrt(_e2(s))
    radius, alpha, _ = _krueger(_e2(s))
    chi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    return s.a * radius * (chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(alpha, 1)))


def _around(degrees: Column, F=F) -> Column:
    """Between -180 and 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def project(s: System, lon: Column, lat: Column, F=F) -> tuple[Column, Column]:
    """Degrees on the system's own ellipsoid to its coordinates."""
    if s.kind == "longlat":
        return lon, lat
    phi, d, e2 = F.radians(lat), F.radians(_around(lon - F.lit(s.value("lon_0")), F)), _e2(s)
    k = s.value("k", s.value("k_0", 1.0))
    if s.kind == "tmerc":
        radius, alpha, _ = _krueger(e2)
        e, sn = math.sqrt(e2), F.sin(phi)

        def summed(v: Column) -> Column:
            xi, eta = v["xi"], v["eta"]
            x = sum((F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), eta)
            y = sum((F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), xi)
            return _named(F, x=x, y=y)

        t = F.sinh(F.atanh(sn) - F.lit(e) * F.atanh(F.lit(e) * sn))
        plane = _let(t, lambda t: _let(_named(F, xi=F.atan2(t, F.cos(d)), eta=F.atanh(F.sin(d) / F.sqrt(1 + t * t))), summed, F), F)
        x, y = F.lit(k * s.a * radius) * plane["x"], F.lit(k * s.a * radius) * plane["y"] - F.lit(k * _origin(s))
    elif s.kind == "merc":
        k = _m(math.radians(s.value("lat_ts")), e2) if "lat_ts" in s.at else k
        x, y = F.lit(k * s.a) * d, -F.lit(k * s.a) * F.log(_t_of(phi, e2, F))
    elif s.kind == "lcc":
        n, scale, origin = _conic(s)
        rho = F.lit(scale) * F.pow(_t_of(phi, e2, F), F.lit(n))
        x, y = rho * F.sin(F.lit(n) * d), F.lit(origin) - rho * F.cos(F.lit(n) * d)
    else:
        north = s.value("lat_0") > 0
        rho = F.lit(_polar(s)) * _t_of(phi if north else -phi, e2, F)
        x, y = rho * F.sin(d), rho * F.cos(d) * (-1 if north else 1)
    return (x + F.lit(s.value("x_0"))) / F.lit(s.unit), (y + F.lit(s.value("y_0"))) / F.lit(s.unit)


def unproject(s: System, x: Column, y: Column, F=F) -> tuple[Column, Column]:
    """Coordinates to degrees on the system's own ellipsoid."""
    if s.kind == "longlat":
        return x, y
    x, y, e2 = x * F.lit(s.unit) - F.lit(s.value("x_0")), y * F.lit(s.unit) - F.lit(s.value("y_0")), _e2(s)
    k = s.value("k", s.value("k_0", 1.0))
    if s.kind == "tmerc":
        radius, _, beta = _krueger(e2)
        xi, eta = (y + F.lit(k * _origin(s))) / F.lit(k * s.a * radius), x / F.lit(k * s.a * radius)

        def summed(v: Column) -> Column:
            xi, eta = v["xi"], v["eta"]
            a = xi - sum((F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
            b = eta - sum((F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
            return _let(_named(F, a=a, b=b), lambda w: _named(F, d=F.atan2(F.sinh(w["b"]), F.cos(w["a"])), chi=F.asin(F.sin(w["a"]) / F.cosh(w["b"]))), F)

        sphere = _let(_named(F, xi=xi, eta=eta), summed, F)
        d, chi = sphere["d"], sphere["chi"]
    elif s.kind == "merc":
        k = _m(math.radians(s.value("lat_ts")), e2) if "lat_ts" in s.at else k
        d, chi = x / F.lit(k * s.a), F.lit(math.pi / 2) - 2 * F.atan(F.exp(-y / F.lit(k * s.a)))
    elif s.kind == "lcc":
        n, scale, origin = _conic(s)
        sign = 1.0 if n > 0 else -1.0
        v = F.lit(origin) - y
        t = F.pow(F.sqrt(x * x + v * v) / F.lit(abs(scale)), F.lit(1 / n))
        d, chi = F.atan2(F.lit(sign) * x, F.lit(sign) * v) / F.lit(n), F.lit(math.pi / 2) - 2 * F.atan(t)
    else:
        north = s.value("lat_0") > 0
        t = F.sqrt(x * x + y * y) / F.lit(_polar(s))
        d = F.atan2(x, -y if north else y)
        chi = (F.lit(math.pi / 2) - 2 * F.atan(t)) * (1 if north else -1)
    return _around(F.degrees(d) + F.lit(s.value("lon_0")), F), F.degrees(_latitude(chi, e2, F))


def _centric(s: System, lon: Column, lat: Column, back: bool, F=F) -> tuple[Column, Column]:
    """Degrees of one datum to the other's, through the Earth's centre, at no height; back leads from WGS 84 to the system."""
    wgs = System("longlat", *ELLIPSOIDS["wgs84"])
    given, wanted = (wgs, s) if back else (s, wgs)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(given.a) / F.sqrt(1 - F.lit(given.e2) * F.sin(phi) * F.sin(phi))
    p = (n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * F.lit(1 - given.e2) * F.sin(phi))
    move, turn, ppm = s.shift[:3], [v * _SECOND for v in (*s.shift[3:6], 0, 0, 0)[:3]], (s.shift[6] if len(s.shift) > 6 else 0.0) * 1e-6
    rx, ry, rz = turn
    matrix = [[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]
    if back:
        q = [(c - F.lit(m)) / F.lit(1 + ppm) for c, m in zip(p, move, strict=True)]
        # the inverse of a turn by some seconds, to the second order
        w = [[sum(matrix[k][i] * matrix[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
        inverse = [[2 * matrix[j][i] - sum(w[i][k] * matrix[j][k] for k in range(3)) for j in range(3)] for i in range(3)]
        x, y, z = (sum((F.lit(float(inverse[i][j])) * q[j] for j in range(3)), F.lit(0.0)) for i in range(3))
    else:
        x, y, z = (F.lit(move[i]) + F.lit(1 + ppm) * sum((F.lit(float(matrix[i][j])) * p[j] for j in range(3)), F.lit(0.0)) for i in range(3))
    b, e2 = wanted.a * math.sqrt(1 - wanted.e2), wanted.e2

    def geographic(v: Column) -> Column:
        z, r = v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        once = lambda beta: F.atan2(z + F.lit(e2 / (1 - e2) * b) * F.pow(F.sin(beta), F.lit(3.0)), r - F.lit(e2 * wanted.a) * F.pow(F.cos(beta), F.lit(3.0)))
        lat = _let(F.atan2(z * F.lit(wanted.a), r * F.lit(b)), once, F)
        lat = _let(_let(lat, lambda p: F.atan2(F.lit(b / wanted.a) * F.sin(p), F.cos(p)), F), once, F)
        return _named(F, lon=F.degrees(F.atan2(v["y"], v["x"])), lat=F.degrees(lat))

    out = _let(_named(F, x=x, y=y, z=z), geographic, F)
    return out["lon"], out["lat"]


def _pair(step, F):
    """A step on x and y by name that gives them so."""
    return lambda p: _named(F, **dict(zip("xy", step(p), strict=True)))


def _steps(a: System, b: System, F=F) -> list:
    """What leads from the system a to b, each from x and y by name to a pair."""
    shifted = a.shift != b.shift or (a.shift and (a.a, a.inverse_f) != (b.a, b.inverse_f))
    steps = [lambda p: unproject(a, p["x"], p["y"], F)]
    if shifted and any(a.shift):
        steps.append(lambda p: _centric(a, p["x"], p["y"], False, F))
    if shifted and any(b.shift):
        steps.append(lambda p: _centric(b, p["x"], p["y"], True, F))
    return [*steps, lambda p: project(b, p["x"], p["y"], F)]


def transform(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    """Coordinates of one system in another. Systems without parameters to WGS 84 are taken to share its datum."""
    a, b = parse(src), parse(dst)
    if a == b:
        return x, y
    p = F.struct(x.alias("x"), y.alias("y"))
    for step in _steps(a, b):
        p = _let(p, _pair(step, F))
    return p["x"], p["y"]


def transform_arrays(x: np.ndarray, y: np.ndarray, src: str, dst: str) -> tuple[np.ndarray, np.ndarray]:
    """transform() on NumPy arrays; equal to it but for the last bits of the functions."""
    a, b = parse(src), parse(dst)
    if a == b:
        return x, y
    p = {"x": x, "y": y}
    with np.errstate(all="ignore"):
        for step in _steps(a, b, arrays):
            p = _pair(step, arrays)(p)
    return p["x"], p["y"]


def transformed(x: Column, y: Column, paths: list[tuple[str, ...]]) -> Column:
    """array<struct<x,y>>: coordinates along each path of systems, (src, ..., dst), in Arrow batches.

    Column formulas are interpreted inside of higher-order functions, each for
    one row; here a batch goes through each formula at once, which pays where a
    row has many. A null coordinate gives nulls.
    """

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        given = pa.compute.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
        start = [v.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for v in (x, y)]
        out = np.empty((2, len(given), len(paths)))
        for k, path in enumerate(paths):
            at = start
            for src, dst in zip(path, path[1:], strict=False):
                at = transform_arrays(*at, src, dst)
            out[0, :, k], out[1, :, k] = at
        missing = pa.array(np.repeat(~given, len(paths)))
        pairs = [pa.compute.if_else(missing, None, pa.array(v.ravel())) for v in out]
        ends = pa.array(np.arange(len(given) + 1, dtype=np.int32) * len(paths))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, names=["x", "y"]))

    return run(x, y)
