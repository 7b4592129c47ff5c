"""Spectral operators on trace rows and slice rows: Arrow-batched NumPy kernels, one row in and one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amplitudes import agc, on_matrix
from ..kernels import dsp, slices

COMPLEX = "struct<f:array<double>,re:array<double>,im:array<double>>"


def on_samples(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of an array of samples as a column function; nulls and empty arrays stay as they are."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or not len(x) else kernel(np.asarray(x, float)))

    return run


def envelope(samples: Column) -> Column:
    return on_samples(dsp.envelope)(samples)


def butterworth(samples: Column, kind: str, cutoff, fs: float, order: int = 9) -> Column:
    """Zero-phase; the sections are designed once, on the driver."""
    sos = dsp.butter_sos(order, cutoff, kind, fs)
    return on_matrix(lambda x: dsp.sosfiltfilt(sos, x))(samples)


def filter_frequency(samples: Column, freqs, fs: float, kind: str) -> Column:
    return on_samples(lambda x: dsp.filter_frequency(x, freqs, fs, kind))(samples)


def resample(samples: Column, factor: float) -> Column:
    """Fourier resampling to ceil(n / factor) samples."""
    return on_samples(lambda x: dsp.resample(x, int(np.ceil(len(x) / factor))))(samples)


def resample_poly(samples: Column, factor: float) -> Column:
    """Polyphase resampling: by 1 / factor up for factors below one, else by factor down."""
    up, down = (int(round(1 / factor)), 1) if factor < 1 else (1, int(round(factor)))
    return on_samples(lambda x: dsp.resample_poly(x, up, down))(samples)


def smooth(samples: Column, win: int = 11, window: str = "hanning") -> Column:
    return on_samples(lambda x: dsp.smooth(x, win, window) if len(x) >= win else x)(samples)


def polynomial(samples: Column, order: int = 3, kind: str = "high") -> Column:
    return on_samples(lambda x: dsp.polynomial(x, order, kind))(samples)


def savgol(samples: Column, win: int = 7, order: int = 1, deriv: int = 0) -> Column:
    return on_samples(lambda x: dsp.savgol(x, win, order, deriv))(samples)


def cubic_fill(samples: Column, flags: Column) -> Column:
    """Flagged values replaced by the not-a-knot cubic through the others; with fewer than two others they stay."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series, f: pd.Series) -> pd.Series:
        def one(x, bad):
            x, bad = np.array(x, float), np.array(bad, bool)
            if bad.any() and (~bad).sum() > 1:
                at = np.arange(len(x))
                x[bad] = dsp.cubic_spline(at[~bad].astype(float), x[~bad], at[bad].astype(float))
            return x

        return pd.Series([one(x, b) for x, b in zip(s, f, strict=True)])

    return run(samples, flags)


def frequency_spectrum(samples: Column, fs: float, taper: bool = True) -> Column:
    """Amplitude at each frequency k * fs / n as an array."""
    return on_samples(lambda x: dsp.spectrum(x, fs, taper=taper)[1])(samples)


def average_spectrum(traces: DataFrame, fs: float, taper: bool = True) -> DataFrame:
    """k, amplitude: the mean over all traces."""
    s = traces.select(F.posexplode(frequency_spectrum(F.col("samples"), fs, taper)).alias("k", "a"))
    return s.groupBy("k").agg(F.avg("a").alias("amplitude"))


def fft(samples: Column, dt: float, t0: float = 0.0, upsampling: int = 1, real: bool = False) -> Column:
    """struct<f,re,im> with true phase and amplitude."""

    @F.pandas_udf(COMPLEX)
    def run(s: pd.Series) -> pd.DataFrame:
        out = [dsp.forward(np.asarray(x, float), dt, t0, upsampling, real) for x in s]
        return pd.DataFrame({"f": [f for f, _ in out], "re": [c.real for _, c in out], "im": [c.imag for _, c in out]})

    return run(samples)


def ifft(spec: Column, dt: float, t0: float = 0.0, n: int | None = None, real: bool = False) -> Column:
    @F.pandas_udf("array<double>")
    def run(re: pd.Series, im: pd.Series) -> pd.Series:
        return pd.Series([dsp.backward(np.asarray(a) + 1j * np.asarray(b), dt, t0, n, real) for a, b in zip(re, im, strict=True)])

    return run(spec["re"], spec["im"])


def taper(f: Column, freqs, kind: str = "lowpass") -> Column:
    """Half-Hann weight 0..1 of a frequency; by |f|, so it holds for both signs.

    lowpass: freqs = (pass, stop); highpass: (stop, pass); bandpass: (stop,
    pass, pass, stop).
    """
    a = F.abs(f)
    up = lambda lo, hi: F.when(a <= lo, 0.0).when(a >= hi, 1.0).otherwise(0.5 - 0.5 * F.cos(F.lit(np.pi) * (a - lo) / F.lit(float(hi - lo))))
    if kind == "lowpass":
        return 1 - up(freqs[0], freqs[1])
    if kind == "highpass":
        return up(freqs[0], freqs[1])
    if kind == "bandpass":
        return up(freqs[0], freqs[1]) * (1 - up(freqs[2], freqs[3]))
    raise ValueError(f"unknown filter {kind!r}")


def stopband(n: int, kind: str) -> Column:
    """n ramp samples of a Hann window of 2 n + 1: rising for highpass, falling for lowpass."""
    i = F.sequence(F.lit(1), F.lit(n))
    rise = F.transform(i, lambda k: 0.5 - 0.5 * F.cos(F.lit(np.pi) * k / F.lit(float(n))))
    return rise if kind == "highpass" else F.transform(i, lambda k: 0.5 - 0.5 * F.cos(F.lit(np.pi) * (F.lit(n) + k) / F.lit(float(n))))


#: Values outside of a taper, low and high side.
OUTSIDE = {"highpass": (0, 1), "lowpass": (1, 0), "bandpass": (0, 0)}


def keeps(f: Column, freqs, kind: str = "lowpass") -> Column:
    """Whether a filtered spectrum keeps the frequency at all."""
    a = F.abs(f)
    return {"lowpass": lambda: a <= freqs[-1], "highpass": lambda: a >= freqs[0], "bandpass": lambda: (a >= freqs[0]) & (a <= freqs[-1])}[kind]()


def on_slices(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of a 2-D grid as a column function of (grid, n_xl)."""

    @F.pandas_udf("array<double>")
    def run(grid: pd.Series, n_xl: pd.Series) -> pd.Series:
        return pd.Series([np.ravel(kernel(np.asarray(g, float).reshape(-1, n))) for g, n in zip(grid, n_xl, strict=True)])

    return run


def smooth_slices(sl: DataFrame, name: str = "gaussian", sigma: float = 1.0, size: int = 3, percentiles: tuple[float, float] | None = None) -> DataFrame:
    f = on_slices(lambda x: slices.smoothing(x, name, sigma, size, percentiles))
    return sl.withColumn("grid", f(F.col("grid"), F.col("n_xl")))


def smooth_cube(cube: DataFrame, n_il: int, n_xl: int, name: str = "gaussian", sigma: float = 1.0, size: int = 3, bins: int = 1 << 14, depth: int = 64, samples: str = "samples") -> DataFrame:
    """slice, il, xl, amp: all slices of trace rows (il, xl, samples) smoothed, but no task holds a slice.

    The grid is cut into tiles of about so many bins, and samples into blocks of
    `depth`. A bin goes to its tile and, within the filter's reach of the edge,
    to the neighbours. As in to_slices(), bins without a row or a sample are
    zero, of repeated ones the least value counts.
    """
    r = slices.reach(name, sigma, size)
    height = min(n_il, max(int(bins**0.5), 4 * r))
    width = min(n_xl, max(bins // max(height, 1), 4 * r))
    n = cube.agg(F.max(F.size(samples))).first()[0] or 0
    if not n_il or not n_xl or n <= 0:
        return cube.select(F.lit(0).cast("long").alias("slice"), F.lit(0).alias("il"), F.lit(0).alias("xl"), F.lit(0.0).alias("amp")).limit(0)
    rows, columns, blocks = -(-n_il // height), -(-n_xl // width), -(-n // depth)
    tile = lambda c, side, last: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 1 - r) / side)).cast("int"), F.least(F.lit(last), F.floor((F.col(c) - 1 + r) / side)).cast("int"))
    d = cube.select("il", "xl", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.slice(F.col(samples).cast("array<double>"), b * depth + 1, F.lit(depth)))).alias("block", "v"))
    d = d.select(F.explode(tile("il", height, rows - 1)).alias("row"), "il", "xl", "block", "v").select("row", F.explode(tile("xl", width, columns - 1)).alias("column"), "block", F.col("il").cast("int").alias("il"), F.col("xl").cast("int").alias("xl"), "v")
    # every tile is there, also one without a bin
    k, cast = F.col("id"), lambda c, to="int": c.cast(to)
    every = cube.sparkSession.range(rows * columns * blocks).select(cast(F.floor(k / (columns * blocks))).alias("row"), cast(F.floor(k / blocks) % columns).alias("column"), cast(k % blocks).alias("block"), F.lit(None).cast("int").alias("il"), F.lit(None).cast("int").alias("xl"), F.lit(None).cast("array<double>").alias("v"))

    def smooth(key: tuple, t: pa.Table) -> pa.Table:
        row, column, block = (c.as_py() for c in key)
        y0, y1, x0, x1 = row * height, min(n_il, (row + 1) * height), column * width, min(n_xl, (column + 1) * width)
        top, left = max(0, y0 - r), max(0, x0 - r)
        shape = (min(n_il, y1 + r) - top, min(n_xl, x1 + r) - left)
        ns = min(depth, n - block * depth)
        t = t.filter(pa.compute.is_valid(t.column("v"))).combine_chunks()
        v = t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
        place = (t.column("il").to_numpy() - 1 - top) * shape[1] + t.column("xl").to_numpy() - 1 - left
        lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(place.astype(np.int64), lengths)
        i = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        given = np.full((ns, shape[0] * shape[1]), np.nan)
        held = np.zeros(given.shape, bool)
        np.fmin.at(given, (i, at), v.flatten().to_numpy(zero_copy_only=False))
        held[i, at] = True
        given[~held] = 0
        out = np.empty((y1 - y0, x1 - x0, ns))
        for j in range(ns):
            out[:, :, j] = slices.smoothing(given[j].reshape(shape), name, sigma, size)[y0 - top : y1 - top, x0 - left : x1 - left]
        il, xl = np.mgrid[y0 + 1 : y1 + 1, x0 + 1 : x1 + 1].astype(np.int32)
        ends = pa.array(np.arange(il.size + 1, dtype=np.int32) * ns)
        return pa.table({"block": pa.array(np.full(il.size, block, np.int32)), "il": il.ravel(), "xl": xl.ravel(), "v": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})

    done = d.unionByName(every).groupBy("row", "column", "block").applyInArrow(lambda key, t: smooth(key, t), "block int, il int, xl int, v array<double>")
    e = done.select("block", "il", "xl", F.posexplode("v").alias("i", "amp"))
    return e.select((F.col("block").cast("long") * depth + F.col("i")).alias("slice"), "il", "xl", "amp")


def remove_footprint(sl: DataFrame, n_il: int, n_xl: int, sigma: float = 7, direction: str = "both", buffer_center: float = 0.25, buffer_filter: int = 3) -> DataFrame:
    """The notch in the wavenumber domain; its weights are made once."""
    weights = slices.footprint_filter((n_il, n_xl), sigma, direction, buffer_center, buffer_filter)
    return sl.withColumn("grid", on_slices(lambda x: slices.filtered(x, weights))(F.col("grid"), F.col("n_xl")))


def antialias(sl: DataFrame, n_il: int, n_xl: int, factors: tuple[float, float], direction: str | None = None, sigma: float = 7) -> DataFrame:
    """Aliases of an upsampling by the factors (iline, xline) damped in the wavenumber domain."""
    weights = slices.antialias_filter((n_il, n_xl), factors, direction, sigma)
    return sl.withColumn("grid", on_slices(lambda x: slices.filtered(x, weights))(F.col("grid"), F.col("n_xl")))


def noise_level(grid: Column, n_xl: Column) -> Column:
    @F.pandas_udf("double")
    def run(g: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([slices.noise_level(np.asarray(x, float).reshape(-1, k)) for x, k in zip(g, n, strict=True)])

    return run(grid, n_xl)


UPSAMPLING = ("linear", "slinear", "nearest", "cubic", "polynomial")


def upsample(cube: DataFrame, axis: str, by: list[str], value: str = "amp", method: str = "linear", order: int = 3) -> DataFrame:
    """Rows for every number of the axis between the least and the largest of each key in `by`.

    linear (or slinear) and nearest (halves to the lower) are window functions;
    cubic is the not-a-knot spline through a key's values, polynomial the spline
    of the given order (1 to 3), both over one key's profile at a time.
    """
    if method not in UPSAMPLING:
        raise ValueError(f"method {method!r} is none of {', '.join(UPSAMPLING)}")
    if method in ("cubic", "polynomial") and not (method == "polynomial" and order == 1):
        kind = {2: "quadratic", 3: "cubic"}[order if method == "polynomial" else 3]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(axis)
            at = np.arange(pdf[axis].iloc[0], pdf[axis].iloc[-1] + 1)
            new = dsp.interpolated(pdf[axis].to_numpy(float), pdf[value].to_numpy(float), at.astype(float), kind)
            return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, axis: at, value: new})

        d = cube.select(*by, axis, F.col(value).cast("double").alias(value))
        return d.groupBy(*by).applyInPandas(run, d.schema)
    ends = cube.groupBy(*by).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    every = ends.select(*by, F.explode(F.sequence("lo", "hi")).alias(axis))
    d = every.join(cube.select(*by, axis, value, F.lit(1).alias("own")), [*by, axis], "left")
    w = Window.partitionBy(*by).orderBy(axis)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at, v = F.when(F.col("own") == 1, F.col(axis)), F.when(F.col("own") == 1, F.col(value))
    a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    x, y = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    k = F.col(axis)
    new = F.when(k - a <= b - k, x).otherwise(y) if method == "nearest" else x + (y - x) * (k - a) / F.nullif(b - a, F.lit(0))
    return d.withColumn(value, F.when(F.col("own") == 1, F.col(value)).otherwise(new)).select(*by, axis, value)


def rescale_envelope(df: DataFrame, value: str = "amp") -> DataFrame:
    """Negative amplitudes to zero, then all to 0..1 by the cube's least and largest: a one-row aggregate is joined."""
    d = df.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    ends = d.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return d.crossJoin(F.broadcast(ends)).withColumn(value, F.when(F.col("lo") == F.col("hi"), F.col(value)).otherwise((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")
