"""Separable orthogonal wavelet transform of a slice, periodic at the borders."""

from __future__ import annotations

import numpy as np

#: Scaling filter of Daubechies' wavelet with four vanishing moments, from its defining equations.


def scaling_filter(moments: int = 4) -> np.ndarray:
    """Daubechies' extremal-phase filter by spectral factorisation."""
    from math import comb

    p = np.array([comb(moments - 1 + k, k) for k in range(moments)][::-1], float)
    roots = []
    for y in np.roots(p):  # y = (2 - z - 1/z) / 4; keep the root inside the unit circle
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.argmin(np.abs(z))])
    h = np.poly(np.r_[-np.ones(moments), roots]).real
    return h * np.sqrt(2) / h.sum()


_H = scaling_filter()
#: Values that are copied at once to be filtered (8 MB).
AT_ONCE = 1 << 20


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along the last axis: approximation and detail, half the length each."""
    n, taps = x.shape[-1], len(_H)
    at = (2 * np.arange(n // 2)[:, None] + np.arange(taps)) % n
    filters = np.stack([_H, _H[::-1] * (-1.0) ** np.arange(taps)], axis=1)
    flat = x.reshape(-1, n)
    out = np.empty((2, len(flat), n // 2), np.result_type(x, _H))
    step = max(1, AT_ONCE // (n * taps))  # rows whose windows are copied at once
    for k in range(0, len(flat), step):
        out[:, k : k + step] = np.moveaxis(flat[k : k + step][:, at] @ filters, -1, 0)
    return tuple(v.reshape(*x.shape[:-1], n // 2) for v in out)


def _merge(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    n, taps = 2 * a.shape[-1], len(_H)
    g = _H[::-1] * (-1.0) ** np.arange(taps)
    out = np.zeros((*a.shape[:-1], n), np.result_type(a, d))
    at = (2 * np.arange(n // 2)[:, None] + np.arange(taps)) % n
    for k in range(taps):
        out[..., at[:, k]] += a * _H[k] + d * g[k]
    return out


def forward(shape: tuple[int, int]):
    """(forward, inverse, thresholded) on slices of the shape; sizes are filled to a multiple of 2 ** levels by reflection."""
    levels = max(1, int(np.floor(0.5 * np.log2(max(shape)))))
    unit = 1 << levels
    pads = [(0, -n % unit) for n in shape]

    def fwd(x):
        mode = "symmetric" if all(p[1] <= n for p, n in zip(pads, shape, strict=True)) else "wrap"
        c = [np.pad(x, [(0, 0), pads[1]], mode=mode)]
        for k in range(levels):
            both = list(_split(c.pop(0)))
            split = []
            for v in range(2):  # rows are filled when they have been split, and each half goes when it is used
                half = np.pad(both[v], [pads[0], (0, 0)], mode=mode) if k == 0 else both[v]
                both[v] = None
                split += [y.swapaxes(0, 1) for y in _split(half.swapaxes(0, 1))]
            ll, lh, hl, hh = split
            c = [ll, (lh, hl, hh), *c]
        return c

    def inv(c):
        x = c[0]
        for k, (lh, hl, hh) in enumerate(c[1:], 1):
            rows = shape[0] if k == levels else None  # filled rows are not wanted
            join = lambda a, b, rows=rows: _merge(a.swapaxes(0, 1), b.swapaxes(0, 1)).swapaxes(0, 1)[:rows].copy()
            x = _merge(join(x, lh), join(hl, hh))
        return x[: shape[0], : shape[1]].copy()

    def thresholded(c, f):
        for k in range(1, len(c)):  # in place, so that a second set of coefficients never exists
            level, c[k] = list(c[k]), None
            for j in range(3):
                level[j] = f(level[j])
            c[k] = tuple(level)
        return c

    return fwd, inv, thresholded


def details(c: list) -> np.ndarray:
    """All coefficients but the approximation, which is never thresholded."""
    return np.concatenate([np.ravel(d) for level in c[1:] for d in level])
