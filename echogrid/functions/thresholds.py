"""Threshold operators of the projections, as column functions; complex values are struct<re,im>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hard(x: Column, tau: Column, sub: float = 0.0) -> Column:
    return F.when(F.abs(x) < tau, F.lit(sub)).otherwise(x)


def soft(x: Column, tau: Column, sub: float = 0.0) -> Column:
    return F.when((F.abs(x) < tau) | (x == 0), F.lit(sub)).otherwise(x * F.greatest(1 - tau / F.nullif(F.abs(x), F.lit(0.0)), F.lit(0.0)))


def garrote(x: Column, tau: Column, sub: float = 0.0) -> Column:
    return F.when((F.abs(x) < tau) | (x == 0), F.lit(sub)).otherwise(x * F.greatest(1 - tau * tau / F.nullif(x * x, F.lit(0.0)), F.lit(0.0)))


KINDS = {"hard": hard, "soft": soft, "garrote": garrote, "garotte": garrote}


def threshold(x: Column, tau: Column, kind: str = "soft", sub: float = 0.0) -> Column:
    """kind is hard, soft or garrote; with "-percentile", tau is a value already taken from percentile(abs(x))."""
    base = kind.removesuffix("-percentile")
    if base not in KINDS:
        raise ValueError(f"unknown threshold {kind!r}")
    return KINDS[base](x, tau, sub)


def threshold_complex(z: Column, tau: Column, kind: str = "hard") -> Column:
    """The same on the modulus; the phase stays."""
    m = F.hypot(z["re"], z["im"])
    shrunk = threshold(m, tau, kind)
    f = F.when(m > 0, shrunk / F.nullif(m, F.lit(0.0))).otherwise(0.0)
    return F.struct((z["re"] * f).alias("re"), (z["im"] * f).alias("im"))


def number_of_scales(n_il: Column, n_xl: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(0.5 * F.log2(F.greatest(n_il, n_xl)))).cast("int")


def decay(model: str, niter: int, p_max: float, p_min: float) -> Column:
    """Thresholds of iterations 1..niter as an array: linear, exponential[-q], inverse_proportional[-q]."""
    name, _, q = model.partition("-")
    q = float(q) if q.replace(".", "", 1).isdigit() else 1.0
    k = F.sequence(F.lit(1), F.lit(niter))
    m = lambda i: (i - 1) / F.lit(float(max(niter - 1, 1)))
    if name == "linear":
        return F.transform(k, lambda i: p_max - (p_max - p_min) * m(i))
    if name == "exponential":
        return F.transform(k, lambda i: p_max * F.exp(F.log(F.lit(p_min / p_max)) * F.pow(m(i), F.lit(q))))
    if name == "inverse_proportional":
        n = float(niter) ** q
        a = n * (p_max - p_min) / (n - 1) if n > 1 else 0.0
        return F.transform(k, lambda i: a / F.pow(i.cast("double"), F.lit(q)) + (p_max - a))
    raise ValueError(f"unknown decay {model!r}")
