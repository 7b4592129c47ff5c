"""Outlier tests and one-dimensional interpolation over lines of picks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amplitudes import median_of
from ..kernels import dsp
from .windows import over, whole

KINDS = ("linear", "slinear", "nearest", "nearest-up", "zero", "previous", "next", "quadratic", "cubic")


def zscore(df: DataFrame, keys, value: str, threshold: float = 1.0) -> DataFrame:
    """Adds `outlier`: |x - mean| / population deviation above the threshold."""
    w = whole(keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return df.withColumn("outlier", F.coalesce(F.abs(z) > threshold, F.lit(False)))


def missing(value: Column) -> Column:
    """Whether a sample is null or not a number."""
    return value.isNull() | F.isnan(value)


def quantiles(df: DataFrame, keys, value: str, qs: Sequence[float]) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("q"), F.count("*").alias("n"))


def iqr(df: DataFrame, keys, value: str, factor: float = 1.5) -> DataFrame:
    """Adds `outlier`: outside [q1 - factor * iqr, q3 + factor * iqr], quantiles by linear interpolation."""
    q = quantiles(df, keys, value, (0.25, 0.75)).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = factor * (F.col("q3") - F.col("q1"))
    return df.join(q, keys).withColumn("outlier", (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).drop("q1", "q3")


def mad_of(df: DataFrame, keys, value: str) -> DataFrame:
    """keys, median, mad."""
    m = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    return df.join(m, keys).groupBy(*keys, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))


def double_mad_of(df: DataFrame, keys, value: str) -> DataFrame:
    """keys, median, left, right: the deviation of the values up to the median, and of those from it on."""
    m = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    d = df.join(m, keys)
    dev = F.abs(F.col(value) - F.col("median"))
    side = lambda c: F.percentile(F.when(c, dev), 0.5)
    return d.groupBy(*keys, "median").agg(side(F.col(value) <= F.col("median")).alias("left"), side(F.col(value) >= F.col("median")).alias("right"))


def mad(df: DataFrame, keys, value: str, threshold: float = 3.0, mode: str = "single") -> DataFrame:
    """Adds `outlier`: |x - median| / mad above the threshold; a mad of 0 counts as 1."""
    if mode == "single":
        d = df.join(mad_of(df, keys, value), keys).withColumn("scale", F.col("mad")).drop("mad")
    else:
        d = df.join(double_mad_of(df, keys, value), keys)
        d = d.withColumn("scale", F.when(F.col(value) >= F.col("median"), F.col("right")).otherwise(F.col("left"))).drop("left", "right")
    scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    return d.withColumn("outlier", F.abs(F.col(value) - F.col("median")) / scale > threshold).drop("median", "scale")


def moving_mad(df: DataFrame, keys, order, value: str, win: int, threshold: float = 3.0) -> DataFrame:
    """Adds `median`, `mad` and `outlier` of the centred odd window, on data mirrored at both ends; a mad of 0 counts as 1."""
    h = win // 2
    rows = over(keys, order)
    d = df.withColumns({"row": F.row_number().over(rows), "n": F.count("*").over(whole(keys)), "v0": F.first(value).over(over(keys, order, None, None)), "v1": F.last(value).over(over(keys, order, None, None))})
    # the mirrored values come out of the frame itself: no rows are added
    frame = F.collect_list(F.struct(F.col("row").alias("r"), F.col(value).cast("double").alias("v"))).over(over(keys, order, -2 * h, 2 * h))
    d = d.withColumn("frame", frame)
    inside = F.filter("frame", lambda x: F.abs(x["r"] - F.col("row")) <= h)
    left = F.transform(F.filter("frame", lambda x: (x["r"] > 1) & (2 - x["r"] >= F.col("row") - h)), lambda x: F.col("v0") - F.abs(x["v"] - F.col("v0")))
    right = F.transform(F.filter("frame", lambda x: (x["r"] < F.col("n")) & (2 * F.col("n") - x["r"] <= F.col("row") + h)), lambda x: F.col("v1") - F.abs(x["v"] - F.col("v1")))
    d = d.withColumn("w", F.concat(F.transform(inside, lambda x: x["v"]), left, right))
    d = d.withColumn("median", median_of(F.col("w")))
    d = d.withColumn("mad", median_of(F.transform("w", lambda x: F.abs(x - F.col("median")))))
    scale = F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
    return d.withColumn("outlier", F.abs(F.col(value) - F.col("median")) / scale > threshold).drop("row", "n", "v0", "v1", "frame", "w")


def keep_boundaries(df: DataFrame, keys, order, flag: str = "outlier") -> DataFrame:
    """Takes the flag from the runs of flagged rows at both ends of a line, so that nothing is extrapolated."""
    good = F.when(~F.col(flag), 1)
    before, after = F.sum(good).over(over(keys, order, None, 0)), F.sum(good).over(over(keys, order, 0, None))
    return df.withColumn(flag, F.col(flag) & before.isNotNull() & after.isNotNull())


def interpolated(df: DataFrame, keys, order, value: str, flag: str = "outlier", kind: str = "linear") -> DataFrame:
    """Replaces flagged values from the others of the line, by their row numbers.

    linear (slinear), previous (zero), next, nearest (halves to the earlier) and
    nearest-up (to the later) are window functions; quadratic and cubic splines
    take a line's values together.
    """
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r} is none of {', '.join(KINDS)}")
    if kind in ("quadratic", "cubic"):
        return _spline_filled(df, keys, order, value, flag, kind)
    d = df.withColumn("row", F.row_number().over(over(keys, order)))
    at, v = F.when(~F.col(flag), F.col("row")), F.when(~F.col(flag), F.col(value))
    back, ahead = over(keys, order, None, 0), over(keys, order, 0, None)
    a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    x, y = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    r = F.col("row")
    new: Column = {
        "linear": x + (y - x) * (r - a) / F.nullif(b - a, F.lit(0)),
        "previous": x,
        "next": y,
        "nearest": F.when(r - a <= b - r, x).otherwise(y),
        "nearest-up": F.when(r - a < b - r, x).otherwise(y),
    }[{"slinear": "linear", "zero": "previous"}.get(kind, kind)]
    return d.withColumn(value, F.when(F.col(flag), F.coalesce(new, x, y)).otherwise(F.col(value))).drop("row")


def _spline_filled(df: DataFrame, keys, order, value: str, flag: str, kind: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == value else f.dataType) for f in df.schema.fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, bad = pdf[value].to_numpy(float).copy(), pdf[flag].to_numpy(bool)
        good = np.flatnonzero(~bad)
        if bad.any() and len(good):
            at = np.flatnonzero(bad).clip(good[0], good[-1])
            v[bad] = dsp.interpolated(good.astype(float), v[good], at.astype(float), kind)
        return pdf.assign(**{value: v})

    return _line_by_line(df, keys, order, schema, run)


def _line_by_line(df: DataFrame, keys, order, schema: T.StructType, kernel) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(lambda pdf: kernel(pdf.sort_values(list(order), kind="stable")), schema)


def moving_zscore(df: DataFrame, keys, order, value: str, win: int = 11, threshold: float = 1.0) -> DataFrame:
    """Adds `outlier`: |x - Hann-weighted moving mean| / the line's population deviation above the threshold. A line with fewer values than the window has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        if len(x) < win or x.std() == 0:
            return pdf.assign(outlier=False)
        return pdf.assign(outlier=np.abs(x - dsp.smooth(x, win)) / x.std() > threshold)

    return _line_by_line(df, keys, order, T.StructType([*df.schema.fields, T.StructField("outlier", T.BooleanType())]), run)


def replaced(df: DataFrame, keys, order, value: str, method: str = "IQR", kind: str = "linear", win: int = 11, threshold: float = 3.0, boundaries: bool = True) -> DataFrame:
    """Outliers found by IQR, z-score, r_z-score, MAD, doubleMAD or r_singleMAD / r_doubleMAD (r_: rolling), then interpolated by one of KINDS. Adds `outlier`."""
    if method == "IQR":
        d = iqr(df, keys, value)
    elif method == "z-score":
        d = zscore(df, keys, value)
    elif method == "r_z-score":
        d = moving_zscore(df, keys, order, value, win)
    elif method in ("MAD", "doubleMAD"):
        d = mad(df, keys, value, threshold, "single" if method == "MAD" else "double")
    elif method in ("r_singleMAD", "r_doubleMAD"):
        d = moving_mad(df, keys, order, value, win, threshold).drop("median", "mad")
    else:
        raise ValueError(f"unknown method {method!r}")
    if boundaries:
        d = keep_boundaries(d, keys, order)
    return interpolated(d, keys, order, value, kind=kind)
