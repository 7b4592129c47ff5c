"""Tides from a gridded model of harmonic constants.

A model is a raster of places by latitude and longitude with a complex constant
hc = amplitude * exp(-i * phase) for each constituent. A place takes those of
the four raster points around it, bilinearly, from the ones that are water. The
tide is the sum of f * Re(hc * exp(i * (V + u))), where V is the equilibrium
argument at that time and f, u are the nodal corrections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mean longitudes of moon, sun, lunar perigee, lunar node in degrees at noon of 1 January 2000, and degrees a day.
EPOCH_MJD = 51544.4993
LONGITUDES = {"s": (218.3164, 13.17639648), "h": (280.4661, 0.98564736), "p": (83.3535, 0.11140353), "n": (125.0445, -0.05295377)}
SOLAR_PERIGEE = 282.94
#: Multiples of the hour angle, s, h, p and the solar perigee, and degrees that are added.
ARGUMENTS = {
    "m2": (2, -2, 2, 0, 0, 0), "s2": (2, 0, 0, 0, 0, 0), "n2": (2, -3, 2, 1, 0, 0), "k2": (2, 0, 2, 0, 0, 0), "2n2": (2, -4, 2, 2, 0, 0),
    "k1": (1, 0, 1, 0, 0, 90), "o1": (1, -2, 1, 0, 0, -90), "p1": (1, 0, -1, 0, 0, -90), "q1": (1, -3, 1, 1, 0, -90),
    "m4": (4, -4, 4, 0, 0, 0), "ms4": (4, -2, 2, 0, 0, 0), "mn4": (4, -5, 4, 1, 0, 0), "mf": (0, 2, 0, 0, 0, 0), "mm": (0, 1, 0, -1, 0, 0),
    "2q1": (1, -4, 1, 2, 0, -90), "sigma1": (1, -4, 3, 0, 0, -90), "rho1": (1, -3, 3, -1, 0, -90), "m1a": (1, -1, 1, -1, 0, 90), "m1b": (1, -1, 1, 1, 0, -90),
    "chi1": (1, -1, 3, -1, 0, 90), "pi1": (1, 0, -2, 0, 1, -90), "phi1": (1, 0, 3, 0, 0, 90), "theta1": (1, 1, -1, 1, 0, 90), "j1": (1, 1, 1, -1, 0, 90), "oo1": (1, 2, 1, 0, 0, 90),
    "mu2": (2, -4, 4, 0, 0, 0), "nu2": (2, -3, 4, -1, 0, 0), "lambda2": (2, -1, 0, 1, 0, 180), "l2a": (2, -1, 2, -1, 0, 180), "l2b": (2, -1, 2, 1, 0, 0), "t2": (2, 0, -1, 0, 1, 0),
}
#: Nodal factor a + b * cos(node), and phase c * sin(node) in degrees; a power of another's for overtides.
NODAL = {"m2": (1.0, -0.037, -2.1), "o1": (1.009, 0.187, 10.8), "k1": (1.006, 0.115, -8.9), "k2": (1.024, 0.286, -17.7), "mf": (1.043, 0.414, -23.7), "mm": (1.0, -0.130, 0.0)}
NODAL_OF = {"n2": ("m2", 1), "2n2": ("m2", 1), "mu2": ("m2", 1), "nu2": ("m2", 1), "l2a": ("m2", 1), "ms4": ("m2", 1), "m4": ("m2", 2), "mn4": ("m2", 2), "q1": ("o1", 1), "2q1": ("o1", 1), "sigma1": ("o1", 1), "rho1": ("o1", 1)}
#: Minor constituents as sums of major ones.
MINOR = {
    "2q1": {"q1": 0.263, "o1": -0.0252}, "sigma1": {"q1": 0.297, "o1": -0.0264}, "rho1": {"q1": 0.164, "o1": 0.0048}, "m1a": {"o1": 0.0140, "k1": 0.0101}, "m1b": {"o1": 0.0389, "k1": 0.0282},
    "chi1": {"o1": 0.0064, "k1": 0.0060}, "pi1": {"o1": 0.0030, "k1": 0.0171}, "phi1": {"o1": -0.0015, "k1": 0.0152}, "theta1": {"o1": -0.0065, "k1": 0.0155}, "j1": {"o1": -0.0389, "k1": 0.0836}, "oo1": {"o1": -0.0431, "k1": 0.0613},
    "2n2": {"n2": 0.264, "m2": -0.0253}, "mu2": {"n2": 0.298, "m2": -0.0264}, "nu2": {"n2": 0.165, "m2": 0.00487}, "lambda2": {"m2": 0.0040, "s2": 0.0074}, "l2a": {"m2": 0.0131, "s2": 0.0326}, "l2b": {"m2": 0.0033, "s2": 0.0082}, "t2": {"s2": 0.0585},
}


@dataclass(frozen=True)
class Raster:
    """Where the raster's point (iy, ix) lies, from 0; a full circle of longitudes closes on itself."""

    lat: float
    lon: float
    step_lat: float
    step_lon: float

    @property
    def around(self) -> int:
        """Points of a full circle."""
        return round(360 / self.step_lon)


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, Raster, list[str]]:
    """A model from a Parquet table (constituent, lat, lon, amplitude in m, phase in degrees): its cells, raster and constituents.

    Points without a value (land) are left out of the table, or null.
    """
    t = spark.read.parquet(path).where("amplitude IS NOT NULL AND phase IS NOT NULL")
    axes = []
    for axis in ("lat", "lon"):
        lo, hi, n = t.agg(F.min(axis), F.max(axis), F.count_distinct(axis)).first()
        axes.append((lo, (hi - lo) / max(n - 1, 1) or 1.0))
    raster = Raster(axes[0][0], axes[1][0], axes[0][1], axes[1][1])
    names = sorted(r[0] for r in t.select(F.lower("constituent")).distinct().collect())
    return cells(t, raster, names), raster, names


def cells(points: DataFrame, raster: Raster, names: list[str]) -> DataFrame:
    """iy, ix and re_, im_ of each constituent: a row a raster point, of (constituent, lat, lon, amplitude, phase)."""
    unknown = sorted(set(names) - set(ARGUMENTS))
    if unknown:
        raise ValueError(f"no arguments for {', '.join(unknown)}")
    d = points.select(F.rint((F.col("lat") - raster.lat) / raster.step_lat).cast("int").alias("iy"), F.rint((F.col("lon") - raster.lon) / raster.step_lon).cast("int").alias("ix"), F.lower("constituent").alias("c"), "amplitude", F.radians("phase").alias("g"))
    parts = []
    for n in names:
        of = lambda v, n=n: F.max(F.when(F.col("c") == n, v))
        parts += [of(F.col("amplitude") * F.cos("g")).alias(f"re_{n}"), of(-F.col("amplitude") * F.sin("g")).alias(f"im_{n}")]
    return d.groupBy("iy", "ix").agg(*parts)


def at_places(places: DataFrame, model: DataFrame, raster: Raster, names: list[str]) -> DataFrame:
    """Adds re_ and im_ of each constituent to rows with lat and lon; null where none of the four points around is water.

    An equi-join on the raster points, whose table has a row for each, and an
    aggregate of four rows a place.
    """
    y, x = (F.col("lat") - raster.lat) / raster.step_lat, F.pmod(F.col("lon") - raster.lon, F.lit(360.0)) / raster.step_lon
    d = places.withColumns({"__y": y, "__x": x}).withColumns({"__iy": F.floor("__y").cast("int"), "__ix": F.floor("__x").cast("int")})
    fy, fx = F.col("__y") - F.col("__iy"), F.col("__x") - F.col("__ix")
    corner = lambda dy, dx: F.struct((F.col("__iy") + dy).alias("iy"), ((F.col("__ix") + dx) % raster.around).alias("ix"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    own = places.columns
    d = d.withColumn("__c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).select(*own, F.col("__c.iy").alias("iy"), F.col("__c.ix").alias("ix"), F.col("__c.w").alias("__w"))
    j = d.join(model, ["iy", "ix"], "left")
    mean = lambda c: F.sum(F.col("__w") * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("__w"))), F.lit(0.0))
    return j.groupBy(*own).agg(*[mean(f"{part}_{n}").alias(f"{part}_{n}") for n in names for part in ("re", "im")])


def longitudes(time: Column) -> dict[str, Column]:
    """Degrees of the hour angle, s, h, p, node at a time in UTC."""
    mjd = F.unix_timestamp(time) / F.lit(86400.0) + F.lit(40587.0)
    days = mjd - F.lit(EPOCH_MJD)
    return {"t": (mjd - F.floor(mjd)) * 360.0, **{k: F.lit(a) + F.lit(b) * days for k, (a, b) in LONGITUDES.items()}}


def argument(name: str, at: dict[str, Column]) -> Column:
    """The equilibrium argument of a constituent in degrees."""
    t, s, h, p, pp, more = ARGUMENTS[name]
    return t * at["t"] + s * at["s"] + h * at["h"] + p * at["p"] + F.lit(float(pp * SOLAR_PERIGEE + more))


def nodal(name: str, at: dict[str, Column]) -> tuple[Column, Column]:
    """Factor and phase (degrees) of the 18.6 years' cycle."""
    of, power = NODAL_OF.get(name, (name, 1))
    if of not in NODAL:
        return F.lit(1.0), F.lit(0.0)
    a, b, c = NODAL[of]
    node = F.radians(at["n"])
    f = F.lit(a) + F.lit(b) * F.cos(node)
    return (f if power == 1 else f**power), F.lit(c * power) * F.sin(node)


def elevation(time: Column, names: list[str], correct_minor: bool = False) -> Column:
    """Metres above the mean level from columns re_ and im_; minor constituents that the model lacks are inferred from its major ones."""
    at, parts = longitudes(time), {n: (F.col(f"re_{n}"), F.col(f"im_{n}")) for n in names}
    if correct_minor:
        for n, of in MINOR.items():
            if n not in names and set(of) <= set(names):
                parts[n] = tuple(sum((F.lit(w) * F.col(f"{part}_{m}") for m, w in of.items()), F.lit(0.0)) for part in ("re", "im"))
    out = F.lit(0.0)
    for n, (re, im) in parts.items():
        f, u = nodal(n, at)
        angle = F.radians(argument(n, at) + u)
        out = out + f * (re * F.cos(angle) - im * F.sin(angle))
    return out


def predict(places: DataFrame, model: DataFrame, raster: Raster, names: list[str], correct_minor: bool = False) -> DataFrame:
    """Adds tide (m) to rows with lat, lon and time; null on land."""
    d = at_places(places, model, raster, names).withColumn("tide", elevation(F.col("time"), names, correct_minor))
    return d.select(*places.columns, "tide")
