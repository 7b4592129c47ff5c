"""Projection onto convex sets: fills the empty bins of a slice by thresholding its transform, again and again."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import frames, wavelets

TRANSFORMS = ("FFT", "DCT", "WAVELET", *frames.KINDS)
VERSIONS = ("regular", "fast", "adaptive")
#: Coefficients that are thresholded at once; several arrays of that size are in between.
AT_ONCE = 1 << 17


def _shrunk(x: np.ndarray, tau: float, kind: str) -> np.ndarray:
    a = np.abs(x)
    if kind == "hard":
        return np.where(a < tau, 0, x)
    safe = np.where(a == 0, 1, a)
    if kind == "soft":
        f = 1 - tau / safe
    elif kind in ("garrote", "garotte"):
        f = 1 - tau**2 / safe**2
    else:
        raise ValueError(f"unknown threshold {kind!r}")
    return np.where((a < tau) | (a == 0), 0, x * np.maximum(f, 0))


def threshold(x: np.ndarray, tau: float, kind: str = "hard") -> np.ndarray:
    if kind.endswith("-percentile"):
        tau, kind = float(np.percentile(np.abs(x), tau)), kind.removesuffix("-percentile")
    if x.size <= AT_ONCE:
        return _shrunk(x, tau, kind)
    flat = np.ravel(x)
    out = np.empty(flat.shape, np.result_type(x, float))
    for k in range(0, len(flat), AT_ONCE):
        out[k : k + AT_ONCE] = _shrunk(flat[k : k + AT_ONCE], tau, kind)
    return out.reshape(x.shape)


def decay(model: str, niter: int, p_max: float, p_min: float | str, spec: np.ndarray | None = None, kind: str = "values", lexmax: bool = False) -> np.ndarray:
    """A threshold for each iteration.

    values: p_max and p_min are shares of the largest coefficient (its modulus;
    with lexmax, the real part of the lexicographic maximum); p_min may be
    "adaptive", a hundredth of the root mean square. factors: they are the
    thresholds themselves.
    """
    name, _, q = model.partition("-")
    q = float(q) if q.replace(".", "", 1).isdigit() else 1.0
    a = np.abs(spec) if spec is not None else None
    if kind == "factors":
        hi, lo = p_max, float(p_min)
    else:
        top = float(np.max(spec).real) if lexmax else float(a.max())
        hi = p_max * top
        lo = 0.01 * float(np.sqrt((a**2).sum() / a.size)) if p_min == "adaptive" else float(p_min) * top
    k = np.arange(1, niter + 1)
    m = (k - 1) / max(niter - 1, 1)
    if model == "data-driven":
        v = np.sort(a[(a > lo) & (a < hi)])[::-1]
        return v[np.ceil((k - 1) * (len(v) - 1) / max(niter - 1, 1)).astype(int)] if len(v) else np.full(niter, lo)
    if name == "linear":
        return hi - (hi - lo) * m
    if name == "exponential":
        return hi * np.exp(np.log(lo / hi) * m**q)
    if name == "inverse_proportional":
        big, small = (hi, lo) if kind == "factors" else (float(a.max()), float(a.min()))
        n = float(niter) ** q
        c = n * (big - small) / (n - 1) if n > 1 else 0.0
        return c / k**q + (big - c)
    raise ValueError(f"unknown decay {model!r}")


def _dct(n: int) -> np.ndarray:
    c = np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


def _transform(kind: str, shape: tuple[int, int]) -> tuple[Callable, Callable, Callable]:
    """(forward, inverse, thresholded): thresholded applies a function to what may be shrunk."""
    if kind == "FFT":
        return np.fft.fft2, np.fft.ifft2, lambda c, f: f(c)
    if kind == "DCT":
        a, b = _dct(shape[0]), _dct(shape[1])
        return lambda x: a @ x @ b.T, lambda c: a.T @ c @ b, lambda c, f: f(c)
    if kind == "WAVELET":
        return wavelets.forward(shape)
    if kind in frames.KINDS:
        frame = frames.decimated(shape, kind)
        return frame.forward, frame.inverse, lambda c, f: f(c)
    raise ValueError(f"transform {kind!r} is none of {', '.join(TRANSFORMS)}")


def window_decays(frame: frames.Decimated, c: np.ndarray, model: str, niter: int, p_max: float, p_min: float | str, kind: str, lexmax: bool) -> np.ndarray:
    """(iteration, window): a threshold for each window of a frame from its own coefficients.

    "adaptive" is a third of the median over the windows of the root of the
    window's energy a coefficient of the frame, times log10(scale + 1).
    """
    parts = [c[a:b] for a, b in zip(frame.ends, frame.ends[1:], strict=False)]
    least = None
    if p_min == "adaptive":
        least = float(np.median([np.log10(j + 1) * np.sqrt((np.abs(p) ** 2).sum() / len(c)) for j, p in zip(frame.scales, parts, strict=True)])) / 3
    out = np.zeros((niter, len(parts)))
    for k, p in enumerate(parts):
        top = float(np.max(p).real) if lexmax else float(np.abs(p).max(initial=0))
        if top > 0 or kind == "factors":
            out[:, k] = decay(model, niter, p_max, p_min if least is None else max(least, 1e-300) / top, p, kind, lexmax)
    return out


@dataclass
class Result:
    grid: np.ndarray
    niter: int
    cost: float
    runtime: float


def pocs(
    x: np.ndarray,
    mask: np.ndarray,
    niter: int = 50,
    transform: str = "FFT",
    thresh_op: str = "hard",
    thresh_model: str = "exponential",
    eps: float = 1e-9,
    alpha: float = 1.0,
    p_max: float = 0.99,
    p_min: float | str = 1e-5,
    decay_kind: str = "values",
    sqrt_decay: bool = False,
    version: str = "regular",
    compat_cost: bool = False,
    compat_lexmax: bool = False,
    per_window: bool = False,
) -> Result:
    """Fills x where mask is 0.

    regular thresholds the last result; fast extrapolates from the last two
    first; adaptive mixes in the data by alpha. Stops after four iterations or
    more when the cost ||x_k - x_(k-1)||^2 / ||x_k||^2 of the moduli falls below
    eps (compat_cost: squares of sums). A slice of zeros is returned as it is.
    per_window, for shearlets, gives each window its own thresholds; otherwise
    all coefficients share one. (Curvelet windows at coarse scales overlap too
    much for it: measured on plane waves, it ends further off than it began.)
    """
    start = time.perf_counter()
    if mask.max(initial=0) > 1:
        raise ValueError("the mask must be 0 or 1")
    if version not in VERSIONS:
        raise ValueError(f"version {version!r} is none of {', '.join(VERSIONS)}")
    if not np.any(x):
        return Result(x, 0, 0.0, time.perf_counter() - start)
    fwd, inv, shrink = _transform(transform, x.shape)
    first = fwd(x)
    flat = wavelets.details(first) if transform == "WAVELET" else np.ravel(first)
    del first
    least = p_min if p_min == "adaptive" else float(p_min)
    if per_window and transform != "SHEARLET":
        raise ValueError("thresholds by window are for shearlets")
    if per_window:
        frame = frames.decimated(x.shape, transform)
        taus = window_decays(frame, flat, thresh_model, niter, float(p_max), least, decay_kind, compat_lexmax)

        def cut(c: np.ndarray, tau: np.ndarray) -> np.ndarray:
            return np.concatenate([threshold(c[a:b], float(t), thresh_op) for a, b, t in zip(frame.ends, frame.ends[1:], tau, strict=False)])
    else:
        taus = decay(thresh_model, niter, float(p_max), least, flat, decay_kind, compat_lexmax)

        def cut(c: np.ndarray, tau: float) -> np.ndarray:
            return threshold(c, float(tau), thresh_op)
    del flat
    if sqrt_decay:
        taus = np.sqrt(taus)
    am, complex_in = alpha * mask, np.iscomplexobj(x)
    old = before = x
    v, cost, k = 1.0, 0.0, 0
    for k in range(1, niter + 1):  # noqa: B007
        tau = taus[k - 1]
        if version == "fast":
            v1 = (1 + np.sqrt(1 + 4 * v * v)) / 2
            source = old + (v - 1) / v1 * (old - before)
            v = v1
        elif version == "adaptive":
            source = alpha * x + (1 - am) * old + (1 - alpha) * (x - mask * old)
        else:
            source = old
        new = inv(shrink(fwd(source), lambda c, tau=tau: cut(c, tau)))
        if not complex_in:
            new = new.real
        new = new * (1 - am) + alpha * x * mask
        a, b = np.abs(new), np.abs(old)
        cost = float((a - b).sum() ** 2 / (a.sum() ** 2 or 1)) if compat_cost else float(((a - b) ** 2).sum() / ((a**2).sum() or 1))
        before, old = old, new
        if k > 3 and cost < eps:
            break
    return Result(old, k, cost, time.perf_counter() - start)
