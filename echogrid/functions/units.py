"""Conversions between two-way time, depth and samples; coordinate scalars; rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sound velocity in water, m/s.
VELOCITY = 1500.0
#: Units of time in seconds.
SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def _factor(unit: str) -> float:
    if unit not in SECONDS:
        raise ValueError(f"unit {unit!r} is none of {', '.join(SECONDS)}")
    return SECONDS[unit]


def convert_twt(twt: Column, unit_in: str, unit_out: str) -> Column:
    """Between s, ms, us and ns; every pair, the same unit included."""
    return twt * (_factor(unit_in) / _factor(unit_out))


def depth2twt(depth: Column, v: float = VELOCITY) -> Column:
    """m to s, there and back."""
    return depth / (v / 2)


def twt2depth(twt: Column, v: float = VELOCITY, units: str = "s") -> Column:
    return twt * _factor(units) * (v / 2)


def twt2samples(twt: Column, dt: Column | float, units: str = "s") -> Column:
    """twt in s; dt in `units`."""
    return twt / (dt * F.lit(_factor(units)))


def samples2twt(samples: Column, dt: Column | float) -> Column:
    return samples * dt


def depth2samples(depth: Column, dt: Column | float, v: float = VELOCITY, units: str = "s") -> Column:
    return twt2samples(depth2twt(depth, v), dt, units)


def samples2depth(samples: Column, dt: Column | float, v: float = VELOCITY, units: str = "s") -> Column:
    return twt2depth(samples2twt(samples, dt), v, units)


def round_to_multiple(x: Column, multiple: float = 10, method: str = "nearest") -> Column:
    """nearest (halves to even), up or down."""
    rounded = {"nearest": F.rint, "up": F.ceil, "down": F.floor}[method]
    return rounded(x / F.lit(float(multiple))) * F.lit(float(multiple))


def rescale(x: Column, low: Column, high: Column, vmin: float | None = 0, vmax: float | None = 1) -> Column:
    """From [low, high] to [vmin, vmax]; None keeps the own bound; constant data stay as they are."""
    a = low if vmin is None else F.lit(float(vmin))
    b = high if vmax is None else F.lit(float(vmax))
    return F.when(low == high, x).otherwise(a + (x - low) * ((b - a) / (high - low)))


def scale_coordinate(x: Column, scalar: Column, units: Column) -> Column:
    """Header integer to coordinate: units 1 by the scalar (negative divides, 0 is none), units 2 are seconds of arc in thousandths; else null."""
    length = F.when(scalar < 0, x / F.abs(scalar)).when(scalar > 0, (x * scalar).cast("double")).otherwise(x.cast("double"))
    return F.when(units == 1, length).when(units == 2, x / F.lit(3_600_000.0))


def unscale_coordinate(x: Column, scalar: Column) -> Column:
    """Coordinate to header integer, halves to even; the inverse of scale_coordinate for units 1."""
    scaled = F.when(scalar < 0, x * F.abs(scalar)).when(scalar > 0, x / scalar).otherwise(x)
    return F.rint(scaled).cast("int")


def scalar_multiplier(scalar: Column) -> Column:
    """abs(scalar) ** -sign(scalar), 1 for 0."""
    return F.when(scalar == 0, 1.0).otherwise(F.pow(F.abs(scalar).cast("double"), -F.signum(scalar)))


def auto_scalar(x: Column, digits: int = 9) -> Column:
    """The power of ten that fills a header integer: -(10 ** (digits - integer digits)), for the texts of coordinates."""
    whole = F.length(F.split_part(F.abs(x.cast("double")).cast("decimal(30,10)").cast("string"), F.lit("."), F.lit(1)))
    return (-F.pow(F.lit(10.0), digits - whole)).cast("long")


def dms2dd(dms: Column) -> Column:
    """DDDMMSS[ss] as text to decimal degrees; digits after the seconds are hundredths."""
    s = dms.cast("string")
    return F.substring(s, 1, 3).cast("double") + F.substring(s, 4, 2).cast("double") / 60 + (F.substring(s, 6, 2).cast("double") + F.coalesce(F.nullif(F.substring(s, 8, 2), F.lit("")).cast("double"), F.lit(0.0)) / 100) / 3600


def agc_samples(win: Column, dt: Column) -> Column:
    """Window in samples, made odd."""
    n = F.floor(F.round(win / dt, 9)).cast("int")
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def resampled_twt(i: Column, t0: Column, dt: Column, n: Column, n_resampled: Column) -> Column:
    """Time of sample i after n samples became n_resampled."""
    return t0 + i * dt * n / n_resampled


def resampling_factor(dt: float, interval: float | None = None, frequency: float | None = None, factor: float | None = None) -> float:
    """New interval / old: by interval (in the unit of dt, ms), else frequency (kHz), else factor."""
    if interval is not None:
        return interval / dt
    if frequency is not None:
        return 1 / frequency / dt
    if factor is None:
        raise ValueError("one of interval, frequency and factor is needed")
    return factor


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.rint(x * power) / power)


def snap_inside(x: Column, low: bool, eps: float = 1e-9) -> Column:
    """Extent to integer: moved inwards by eps, halves to even."""
    return F.rint(x + F.lit(eps if low else -eps)).cast("int")
