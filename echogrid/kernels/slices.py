"""Filters on one slice of the cube: kernels, smoothing, footprint, antialiasing, noise."""

from __future__ import annotations

import numpy as np


def gaussian_kernel(sigma: float = 7, orientation: str = "equal", normalised: bool = True) -> np.ndarray:
    """Outer product of two Gaussians of 8 sigma + 1 values (2 sigma + 1 across the orientation)."""
    wide, narrow = int(8 * sigma) + 1, int(2 * sigma) + 1
    ny, nx = {"equal": (wide, wide), "iline": (wide, narrow), "xline": (narrow, wide)}[orientation]
    g = lambda n: np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    k = np.outer(g(ny), g(nx))
    return k / (2 * np.pi * sigma**2) if normalised else k


def convolve(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Mode 'same', by FFT."""
    shape = [a + b - 1 for a, b in zip(x.shape, k.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(x, shape) * np.fft.rfft2(k, shape), shape)
    a, b = ((n - 1) // 2 for n in k.shape)
    return full[a : a + x.shape[0], b : b + x.shape[1]]


def reach(name: str, sigma: float = 1.0, size: int = 3) -> int:
    """Bins on each side of one that its smoothed value depends on."""
    return int(4 * sigma + 0.5) if name == "gaussian" else size // 2


def gaussian(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Separable, truncated at 4 sigma, reflected at the borders."""
    r = reach("gaussian", sigma)
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, p)
    return x


def median(x: np.ndarray, size: int = 3) -> np.ndarray:
    h = size // 2
    p = np.pad(x, h, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))


def smoothing(x: np.ndarray, name: str, sigma: float = 1.0, size: int = 3, percentiles: tuple[float, float] | None = None) -> np.ndarray:
    """gaussian or median; with percentiles, rescaled to the range that the slice had between them."""
    y = gaussian(x, sigma) if name == "gaussian" else median(x, size)
    if percentiles is None:
        return y
    (a, b), (c, d) = np.percentile(x, percentiles), np.percentile(y, percentiles)
    return y if c == d else a + (y - c) * (b - a) / (d - c)


def _weights(shape: tuple[int, int], open_: np.ndarray, pad: int, sigma: float) -> np.ndarray:
    """A padded pattern of zeros and ones made smooth, cut to the shape and rescaled to 0..1."""
    m = convolve(open_, gaussian_kernel(sigma))[pad // 2 : pad // 2 + shape[0], pad // 2 : pad // 2 + shape[1]]
    return (m - m.min()) / (m.max() - m.min() or 1)


def footprint_filter(shape: tuple[int, int], sigma: float = 7, direction: str = "both", buffer_center: float = 0.25, buffer_filter: int = 3) -> np.ndarray:
    """Weights in the wavenumber domain (unshifted): bars along the axes, smooth, inverted; the centre stays open.

    A footprint along inlines (rows) lies on the column of zero crossline
    wavenumber, one along crosslines on the row of zero inline wavenumber. On a
    profile (rows are traces, columns time), twt takes the bar along the shorter
    axis's wavenumber: crosslines if there are more rows than columns, else
    inlines.
    """
    pad = int(5 * sigma)
    n = (shape[0] + pad, shape[1] + pad)
    m = np.zeros(n)
    if direction == "twt":
        direction = "xline" if shape[0] > shape[1] else "iline"
    centre = [slice(k // 2 + 1 - buffer_filter, k // 2 + 2 + buffer_filter) for k in n]
    reach = [round(k * (1 - buffer_center) + 0.5) // 2 for k in n]
    if direction in ("both", "iline"):
        m[: reach[0], centre[1]] = m[n[0] - reach[0] :, centre[1]] = 1
    if direction in ("both", "xline"):
        m[centre[0], : reach[1]] = m[centre[0], n[1] - reach[1] :] = 1
    return np.fft.ifftshift(1 - _weights(shape, m, pad, sigma))


def filtered(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(np.fft.fft2(x) * weights).real


def antialias_filter(shape: tuple[int, int], factors: tuple[float, float], direction: str | None = None, sigma: float = 7, share: float = 0.98) -> np.ndarray:
    """Weights that keep, along one axis, the wavenumbers that the grid held before it was upsampled by the factors (iline, xline).

    The band left out at each side is `share` of 1 - other factor / own factor
    of half the axis; without a direction, that of the axis that was upsampled
    more. Weights are at least 1e-3.
    """
    pad = int(5 * sigma)
    axis = {"iline": 0, "xline": 1}[direction or ("iline" if factors[0] > factors[1] else "xline")]
    out = round(shape[axis] * (1 - factors[1 - axis] / factors[axis]) * share) // 2 + pad
    m = np.zeros((shape[0] + pad, shape[1] + pad))
    np.moveaxis(m, axis, 0)[out : m.shape[axis] - out] = 1
    return np.fft.ifftshift(1e-3 + (1 - 1e-3) * _weights(shape, m, pad, sigma))


def noise_level(x: np.ndarray) -> float:
    """Immerkaer's estimate on the slice rescaled to 0..255."""
    lo, hi = x.min(), x.max()
    y = (x - lo) / (hi - lo) * 255 if hi > lo else x
    k = np.array([[1.0, -2, 1], [-2, 4, -2], [1, -2, 1]])
    p = np.pad(y, 2)
    full = sum(k[a, b] * p[2 - a : 2 - a + y.shape[0] + 2, 2 - b : 2 - b + y.shape[1] + 2] for a in range(3) for b in range(3))
    h, w = y.shape
    return float(np.abs(full).sum() * np.sqrt(np.pi / 2) / (6 * (w - 2) * (h - 2)))
