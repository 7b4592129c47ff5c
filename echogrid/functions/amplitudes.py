"""Per-trace amplitude functions on arrays of samples: gain stages, padding, shifts, references.

All work on one row, without a shuffle: higher-order functions, and a kernel in
Arrow batches for gain control.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import dsp


def zeros(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def snr(signal: Column, noisy: Column) -> Column:
    """Aggregate: signal to noise in dB, 10 log10 of the energies of the signal and of its difference to the noisy one."""
    e = signal - noisy
    return 10 * F.log10(F.sum(signal * signal) / F.sum(e * e))


def psnr(signal: Column, noisy: Column, peak: float = 1.0) -> Column:
    """Aggregate: peak signal to noise in dB, 10 log10 of the peak and the root mean square difference."""
    e = signal - noisy
    return 10 * F.log10(F.lit(float(peak)) / F.sqrt(F.avg(e * e)))


def rms(s: Column) -> Column:
    return F.sqrt(total(F.transform(s, lambda x: x * x)) / F.size(s))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, however often, and for however many samples, the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_of(a: Column) -> Column:
    """Median of an array; the mean of the middle two for an even size. Nulls don't count."""

    def of(b):
        n = F.size(b)
        return (F.get(b, F.floor((n - 1) / 2).cast("int")) + F.get(b, F.floor(n / 2).cast("int"))) / 2

    return once(F.sort_array(F.filter(a, F.isnotnull)), of)


def quantile_of(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics. Nulls don't count."""

    def of(b):
        at = (F.size(b) - 1) * F.lit(float(q))
        lo = F.floor(at).cast("int")
        low = F.get(b, lo)
        return low + (F.coalesce(F.get(b, lo + 1), low) - low) * (at - lo)

    return once(F.sort_array(F.filter(a, F.isnotnull)), of)


def reference(s: Column, scale: str = "rms") -> Column:
    """rms, max, mean or median of the absolute amplitudes; 1 instead of 0."""
    a = F.transform(s, F.abs)
    value = {"rms": lambda: rms(s), "max": lambda: F.array_max(a), "peak": lambda: F.array_max(a), "mean": lambda: total(a) / F.size(a), "median": lambda: median_of(a)}[scale]()
    return once(value, lambda v: F.when(v == 0, 1.0).otherwise(v))


def divided(s: Column, by: Column) -> Column:
    return once(by, lambda v: F.transform(s, lambda x: x / v))


def balance(s: Column, scale: str = "rms") -> Column:
    return divided(s, reference(s, scale))


def bias(s: Column, value: float) -> Column:
    return F.transform(s, lambda x: x + value)


def tpow(s: Column, t: Column, power: float) -> Column:
    """x * t ** power; a first sample at time 0 becomes 0."""
    return F.zip_with(s, t, lambda x, u: F.when((u == 0) & F.lit(power < 0), 0.0).otherwise(x * F.pow(u, F.lit(float(power)))))


def epow(s: Column, t: Column, power: float, etpow: float = 1.0, base: float | None = None) -> Column:
    """x * exp(power * t ** etpow), or of another base."""
    exponent = lambda u: power * F.pow(u, F.lit(float(etpow)))
    return F.zip_with(s, t, lambda x, u: x * (F.exp(exponent(u)) if base is None else F.pow(F.lit(float(base)), exponent(u))))


def gpow(s: Column, power: float) -> Column:
    return F.transform(s, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(float(power))))


def clip(s: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds each sample; None leaves a side open."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v if v is None else float(v))

    def all_of(v):
        def one(x):
            x = x if high is None else F.least(x, v["high"])
            return x if low is None else F.greatest(x, v["low"])

        return F.transform(s, one)

    return once(F.struct(col(low).alias("low"), col(high).alias("high")), all_of)


def qclip(s: Column, q: float) -> Column:
    """Symmetric clip at the trace's own quantile of absolute amplitudes."""
    return once(quantile_of(F.transform(s, F.abs), q), lambda v: clip(s, -v, v))


def ramp(s: Column, low: float, high: float) -> Column:
    """Times a line from low to high over the trace."""
    a, b = min(low, high), max(low, high)
    return F.transform(s, lambda x, i: x * (a + (b - a) * i / F.greatest(F.size(s) - 1, F.lit(1))))


def knots(t: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Gain at each time of t: linear between (time, gain) points, constant outside."""
    p = sorted((float(a), float(b)) for a, b in points)

    def at(u):
        out = F.lit(p[-1][1])
        for (t0, g0), (t1, g1) in reversed(list(zip(p, p[1:], strict=False))):
            out = F.when(u <= t1, F.lit(g0) + (u - t0) * ((g1 - g0) / (t1 - t0))).otherwise(out)
        return F.when(u <= p[0][0], F.lit(p[0][1])).otherwise(out)

    return F.transform(t, at)


def times(s: Column, g: Column) -> Column:
    return F.zip_with(s, g, lambda x, y: x * y)


def on_matrix(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A kernel on a matrix (traces x samples) as a column function: traces of one length in a batch are its rows; nulls and empty arrays stay as they are."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = s.copy()
        sizes = s.map(lambda x: -1 if x is None else len(x)).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for i, row in zip(at, kernel(np.stack(s.iloc[at].to_list()).astype(float)), strict=True):
                out.iat[i] = row
        return out

    return run


def agc(s: Column, win: int, kind: str = "rms", squared: bool = False) -> Column:
    """Automatic gain: x / g over a centred window of an odd number of samples.

    Samples beyond the ends are zeros, so edge windows divide by the whole
    window too. g is the rms, mean or median; 1 instead of 0. squared keeps the
    sign of the result and squares its size. Arrow batches with running sums,
    so for rms and mean the cost does not grow with the window.
    """
    return on_matrix(lambda x: dsp.agc(x, win, kind, squared))(s)


def gain(
    s: Column,
    t: Column,
    *,
    bias_value: float | None = None,
    tpow_value: float = 0.0,
    epow_value: float = 0.0,
    etpow: float = 1.0,
    ebase: float | None = None,
    gpow_value: float = 0.0,
    agc_win: int | None = None,
    agc_kind: str = "rms",
    agc_sqrt: bool = False,
    clip_value: float | None = None,
    pclip: float | None = None,
    nclip: float | None = None,
    qclip_value: float | None = None,
    linear: tuple[float, float] | None = None,
    pgc: Sequence[tuple[float, float]] | None = None,
    norm_rms: bool = False,
    scale: float = 1.0,
    norm: bool = False,
) -> Column:
    """The gain chain in its fixed order; each stage is left out at its neutral value."""
    if bias_value:
        s = bias(s, bias_value)
    if tpow_value:
        s = tpow(s, t, tpow_value)
    if epow_value:
        s = epow(s, t, epow_value, etpow, ebase)
    if gpow_value:
        s = gpow(s, gpow_value)
    if agc_win:
        s = agc(s, agc_win, agc_kind, agc_sqrt)
    if clip_value is not None:
        s = clip(s, -abs(clip_value), abs(clip_value))
    if pclip is not None:
        s = clip(s, high=pclip)
    if nclip is not None:
        s = clip(s, low=nclip)
    if qclip_value is not None:
        s = qclip(s, qclip_value)
    if linear is not None:
        s = ramp(s, *linear)
    if pgc is not None:
        s = times(s, knots(t, pgc))
    if norm_rms:
        s = balance(s, "rms")
    if scale != 1.0:
        s = F.transform(s, lambda x: x / scale if norm else x * scale)
    return s


def parse_gain(options: Sequence[str]) -> dict:
    """key=value texts to the arguments of gain(): numbers, words, linear=a,b and pgc=t:g,t:g."""
    names = {"bias": "bias_value", "tpow": "tpow_value", "epow": "epow_value", "gpow": "gpow_value", "clip": "clip_value", "qclip": "qclip_value"}
    out = {}
    for o in options:
        k, _, v = o.partition("=")
        if k == "linear":
            value = tuple(float(x) for x in v.strip("()").split(","))
        elif k == "pgc":
            value = [tuple(float(y) for y in x.split(":")) for x in v.split(",")]
        else:
            try:
                value = float(v)
            except ValueError:
                value = {"true": True, "false": False}.get(v.lower(), v)
        out[names.get(k, k)] = value
    return out


def shifted(s: Column, n: Column) -> Column:
    """Moved by n samples: up (earlier) for n < 0, down for n > 0; zeros come in, the length stays."""
    size = F.size(s)
    k = F.least(F.abs(n), size).cast("int")
    up = F.concat(F.slice(s, k + 1, size - k), zeros(k))
    down = F.concat(zeros(k), F.slice(s, F.lit(1), size - k))
    return F.when(n < 0, up).when(n > 0, down).otherwise(s)


def compensate_static(s: Column, static: Column, dt: Column | None = None) -> Column:
    """static in samples, or in the unit of dt: negative moves up."""
    return shifted(s, F.rint(static if dt is None else static / dt).cast("int"))


def compensate_mistie(s: Column, samples: Column) -> Column:
    """A line's shift: negative moves up."""
    return shifted(s, samples)


def tide_samples(tide: Column, dt: Column, units: str = "meter", dt_units: str = "ms", v: float = 1500.0) -> Column:
    """Tide in meter, s, ms or samples to samples, halves to even."""
    dt_s = dt * {"s": 1.0, "ms": 1e-3}[dt_units]
    n = {"meter": lambda: tide / (v / 2) / dt_s, "s": lambda: tide / dt_s, "ms": lambda: tide * 1e-3 / dt_s, "samples": lambda: tide}[units]()
    return F.rint(n).cast("int")


def compensate_tide(s: Column, samples: Column) -> Column:
    """Positive tide moves up."""
    return shifted(s, -samples)


def padded(s: Column, before: Column | int, after: Column | int) -> Column:
    return F.concat(zeros(before), s, zeros(after))


def mirrored(a: Column, n: int) -> Column:
    """n values more on both ends: a0 - |reverse(a[1..n]) - a0| before, likewise behind."""
    size = F.size(a)
    front, back = F.get(a, F.lit(0)), F.get(a, size - 1)
    before = F.transform(F.reverse(F.slice(a, 2, n)), lambda x: front - F.abs(x - front))
    after = F.transform(F.reverse(F.slice(a, size - n, F.lit(n))), lambda x: back - F.abs(x - back))
    return F.concat(before, a, after)


def first_nonzero(s: Column) -> Column:
    """Number of the first sample that isn't zero, from 0; null if there is none."""
    return F.nullif(F.array_position(F.transform(s, lambda x: x != 0), F.lit(True)), F.lit(0)) - 1


def valid_slice(s: Column, n: int) -> Column:
    """n samples from the first that isn't zero."""
    return F.slice(s, F.coalesce(first_nonzero(s), F.lit(0)).cast("int") + 1, F.lit(n))


def fit_axis(s: Column, delrt: Column, dt: Column, t0: Column, n: int) -> Column:
    """A trace on the axis t0, t0 + dt, ... of n samples: cut or padded with zeros at both ends."""
    top = F.rint((delrt - t0) / dt).cast("int")
    body = F.when(top < 0, F.slice(s, F.abs(top) + 1, F.greatest(F.size(s) + top, F.lit(0)))).otherwise(F.concat(zeros(top), s))
    return F.slice(F.concat(body, zeros(F.lit(n))), 1, n)


def cross_correlation_lag(cc: Column) -> Column:
    """floor(n / 2) - argmax, or argmin where the trough is deeper than the peak is high."""
    at = F.when(F.abs(F.array_min(cc)) > F.abs(F.array_max(cc)), F.array_position(cc, F.array_min(cc))).otherwise(F.array_position(cc, F.array_max(cc)))
    return (F.floor(F.size(cc) / 2) - (at - 1)).cast("int")
