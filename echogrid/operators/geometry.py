"""Affine transforms, extents and polygons, and the cube's bins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f. Immutable; every method returns a new transform."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @staticmethod
    def _pair(value) -> tuple[float, float]:
        return (float(value), float(value)) if isinstance(value, (int, float)) else (float(value[0]), float(value[1]))

    @classmethod
    def build(cls, scaling=1, translation=0, rotation: float = 0, shear=0, matrix=None) -> Affine:
        """Scale, then shear, rotate (degrees, counter-clockwise) and translate; or the upper rows of a matrix."""
        if matrix is not None:
            (a, b, c), (d, e, f) = matrix[0], matrix[1]
            return cls(*map(float, (a, b, c, d, e, f)))
        return cls().scaled(scaling).skewed(shear).rotated(rotation).translated(translation)

    def scaled(self, scale) -> Affine:
        sx, sy = self._pair(scale)
        return Affine(sx, 0, 0, 0, sy, 0) @ self

    def translated(self, offset) -> Affine:
        x, y = self._pair(offset)
        return Affine(1, 0, x, 0, 1, y) @ self

    def rotated(self, angle: float, origin=(0.0, 0.0)) -> Affine:
        r = math.radians(angle)
        x, y = self._pair(origin)
        turn = Affine(math.cos(r), -math.sin(r), 0, math.sin(r), math.cos(r), 0)
        return Affine(1, 0, x, 0, 1, y) @ turn @ Affine(1, 0, -x, 0, 1, -y) @ self

    def skewed(self, shear) -> Affine:
        """Shear angles in degrees."""
        x, y = self._pair(shear)
        return Affine(1, math.tan(math.radians(x)), 0, math.tan(math.radians(y)), 1, 0) @ self

    def __matmul__(self, o: Affine) -> Affine:
        """First o, then self."""
        return Affine(
            self.a * o.a + self.b * o.d, self.a * o.b + self.b * o.e, self.a * o.c + self.b * o.f + self.c,
            self.d * o.a + self.e * o.d, self.d * o.b + self.e * o.e, self.d * o.c + self.e * o.f + self.f,
        )

    __mul__ = __add__ = __matmul__

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def point(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The transform as two expressions."""
        return F.lit(self.a) * x + F.lit(self.b) * y + F.lit(self.c), F.lit(self.d) * x + F.lit(self.e) * y + F.lit(self.f)


def points_from_extent(xmin: float, xmax: float, ymin: float, ymax: float) -> list[tuple[float, float]]:
    """Lower left, upper left, upper right, lower right."""
    return [(xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin)]


def extent_of(df: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    aggs = [F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax")]
    return df.groupBy(*keys).agg(*aggs)


def adjusted(low: Column, high: Column, spacing: float) -> tuple[Column, Column]:
    """Grown on both sides alike until the length is a multiple of the spacing."""
    length = high - low
    more = F.ceil(F.round(length / spacing, 9)) * F.lit(float(spacing)) - length
    return low - more / 2, high + more / 2


def polygons(df: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, area, cx, cy of closed polygons given by their vertices in order; both windings give the same centroid."""
    w = Window.partitionBy(key).orderBy(order)
    first = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.select(key, order, F.col(x).alias("x0"), F.col(y).alias("y0"), F.coalesce(F.lead(x).over(w), F.first(x).over(first)).alias("x1"), F.coalesce(F.lead(y).over(w), F.first(y).over(first)).alias("y1"))
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    g = d.groupBy(key).agg(F.sum(cross).alias("s"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"))
    return g.select(key, (F.abs("s") / 2).alias("area"), (F.col("sx") / (3 * F.nullif("s", F.lit(0.0)))).alias("cx"), (F.col("sy") / (3 * F.nullif("s", F.lit(0.0)))).alias("cy"))


def coords_to_bins(xmin: float, xmax: float, ymin: float, ymax: float, dil: float, dxl: float, base: Affine | None = None) -> Affine:
    """Coordinates to (il, xl): the centre of the first bin is (1, 1); inlines follow y, crosslines x."""
    n_il, n_xl = round((ymax - ymin) / dil), round((xmax - xmin) / dxl)
    to_il = Affine(0, n_il / (ymax - ymin), -(ymin + dil / 2) * n_il / (ymax - ymin) + 1, n_xl / (xmax - xmin), 0, -(xmin + dxl / 2) * n_xl / (xmax - xmin) + 1)
    return to_il @ base if base else to_il


def bins(spark: SparkSession, n_il: int, n_xl: int, transform: Affine) -> DataFrame:
    """il, xl, x, y of every bin; `transform` takes coordinates to (il, xl)."""
    x, y = transform.inverse().columns(F.col("il").cast("double"), F.col("xl").cast("double"))
    # numbers 0 .. n_il * n_xl - 1, split into both: a range is made where it is used and needs no join
    k = spark.range(n_il * n_xl)
    g = k.select((F.floor(F.col("id") / n_xl) + 1).cast("int").alias("il"), (F.col("id") % n_xl + 1).cast("int").alias("xl"))
    return g.select("il", "xl", x.alias("x"), y.alias("y"))


def trace_bins(df: DataFrame, transform: Affine, x: str = "x", y: str = "y") -> DataFrame:
    """Adds il and xl, halves to even."""
    il, xl = transform.columns(F.col(x), F.col(y))
    return df.withColumns({"il": F.rint(il).cast("int"), "xl": F.rint(xl).cast("int")})


def subsampled(df: DataFrame, step_il: int, step_xl: int) -> DataFrame:
    """Bins of a coarser region: every step-th il and xl, numbered anew from 1."""
    new = lambda c, s: (F.floor((F.col(c) - 1) / s) + 1).cast("int")
    return df.where(((F.col("il") - 1) % step_il == 0) & ((F.col("xl") - 1) % step_xl == 0)).withColumns({"il": new("il", step_il), "xl": new("xl", step_xl)})


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def consecutive_distance(df: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Adds `step`, the distance from the row before; null for the first of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step", distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y)))
