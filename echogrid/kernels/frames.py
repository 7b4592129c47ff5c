"""Directional tight frames of a slice: shearlets and curvelets as windows in the wavenumber domain.

The squares of all windows of a frame sum to one at every wavenumber, so the
inverse transform is the transform's adjoint. forward() gives every window a
grid of the slice's size; decimated() wraps each into a rectangle about as large
as its own support.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("SHEARLET", "CURVELET")


def _step(t: np.ndarray) -> np.ndarray:
    """A smooth rise from 0 to 1 on [0, 1] with step(t) + step(1 - t) = 1."""
    t = np.clip(t, 0, 1)
    return t**4 * (35 - 84 * t + 70 * t**2 - 20 * t**3)


def _low(r: np.ndarray) -> np.ndarray:
    """1 up to a radius of 1/2, 0 from 1 on."""
    return np.cos(np.pi / 2 * _step(2 * r - 1))


def _directions(t: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """n windows on a direction t of period n, each over two units; their squares sum to one."""
    return (np.cos(np.pi / 2 * _step(np.abs((t - k + n / 2) % n - n / 2))) for k in range(n))


def each_window(shape: tuple[int, int], kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(scale, window) of each window, real, one at a time; the first one is the low pass, of scale 0.

    SHEARLET: scales of four on squares, a direction by the slope in the cone
    it lies in, 4 * 2 ** j of them at scale j. CURVELET: scales of two on
    circles, a direction by the angle, whose number doubles every second scale.
    Opposite wavenumbers share a window.
    """
    y, x = (np.fft.fftfreq(n) for n in shape)
    y, x = np.broadcast_to(y[:, None], shape), np.broadcast_to(x[None, :], shape)
    if kind == "SHEARLET":
        scales, factor = max(1, int(0.5 * np.log2(max(shape)))), 4.0
        radius = 2 * np.maximum(np.abs(y), np.abs(x))
        flat = np.abs(y) <= np.abs(x)
        slope = np.where(flat, y, x) / np.where(flat, np.where(x == 0, 1, x), np.where(y == 0, 1, y))
        turn, count = np.where(flat, slope, 2 - slope) / 4, lambda j: 4 << j
    elif kind == "CURVELET":
        scales, factor = max(1, int(np.ceil(np.log2(min(shape)) - 3))), 2.0
        radius = 2 * np.hypot(y, x) / np.sqrt(2)
        turn, count = np.arctan2(y, x) / np.pi, lambda j: 8 << ((j + 1) // 2)
    else:
        raise ValueError(f"frame {kind!r} is none of {', '.join(KINDS)}")
    # the outermost low pass is one everywhere; the differences of squares are the bands
    low = _low(radius * factor**scales / 2)
    yield 0, low
    for j in range(scales):
        high = _low(radius * factor ** (scales - j - 1) / 2) if j < scales - 1 else np.ones(shape)
        band = np.sqrt(np.maximum(high**2 - low**2, 0))
        for d in _directions(turn * count(j), count(j)):
            yield j + 1, band * d
        low = high


@lru_cache(maxsize=2)
def windows(shape: tuple[int, int], kind: str) -> np.ndarray:
    """(window, row, column) of each_window()."""
    return np.stack([w for _, w in each_window(shape, kind)])


@dataclass(frozen=True)
class Wedge:
    """A part of a window: the wavenumbers it holds, its values there, and their places in the rectangle they are wrapped into."""

    at: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    size: tuple[int, int]


def _wrapped(w: np.ndarray, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> Wedge:
    """Wavenumbers (rows, columns) of a window wrapped into the smaller of two rectangles.

    One has as many columns as the support, and as many rows as its widest
    column: then no two wavenumbers meet modulo its sides. The other swaps rows
    and columns.
    """

    def sides(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        """(widest range of a at one b, range of b)."""
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        last = np.r_[first[1:], len(a)] - 1
        return int((a[last] - a[first]).max()) + 1, int(b.max() - b.min()) + 1

    by_column, by_row = sides(rows, columns), sides(columns, rows)[::-1]
    size = min(by_column, by_row, key=lambda s: s[0] * s[1])
    at = rows % shape[0] * shape[1] + columns % shape[1]
    return Wedge(at.astype(np.int32), w.ravel()[at], (rows % size[0] * size[1] + columns % size[1]).astype(np.int32), size)


@dataclass(frozen=True)
class Decimated:
    """A frame whose coefficients, one array after the other, are a flat array; those of window k are ends[k]:ends[k + 1]."""

    shape: tuple[int, int]
    wedges: list[Wedge]
    ends: np.ndarray
    scales: np.ndarray

    def forward(self, x: np.ndarray) -> np.ndarray:
        spec, out = np.fft.fft2(x).ravel(), []
        for w in self.wedges:
            box = np.zeros(w.size[0] * w.size[1], complex)
            box[w.to] = spec[w.at] * w.weight
            out.append(np.fft.ifft2(box.reshape(w.size)).ravel() * np.sqrt(len(box) / len(spec)))
        return np.concatenate(out)

    def inverse(self, c: np.ndarray) -> np.ndarray:
        spec, at = np.zeros(self.shape[0] * self.shape[1], complex), 0
        for w in self.wedges:
            n = w.size[0] * w.size[1]
            box = np.fft.fft2(c[at : at + n].reshape(w.size)).ravel()
            spec[w.at] += w.weight * box[w.to] * np.sqrt(len(spec) / n)
            at += n
        return np.fft.ifft2(spec.reshape(self.shape))


@lru_cache(maxsize=2)
def decimated(shape: tuple[int, int], kind: str) -> Decimated:
    """The decimated frame of slices of a shape.

    A window holds two opposite wedges, which are wrapped apart. Energies are
    kept, and forward() followed by inverse() gives the slice back. What is held
    is the windows' supports, some four numbers a wavenumber.
    """
    y, x = (np.round(np.fft.fftfreq(n) * n).astype(int) for n in shape)
    wedges, ends, scales = [], [0], []
    for scale, w in each_window(shape, kind):
        r, c = np.nonzero(w > 1e-8)  # a cosine of a right angle is no zero; squares of what is left out are below rounding
        rows, columns = y[r], x[c]
        along = columns if np.abs(columns).sum() >= np.abs(rows).sum() else rows
        sides = [along > 0, along <= 0] if scale else [np.ones(len(rows), bool)]
        wedges += [_wrapped(w, rows[s], columns[s], shape) for s in sides if s.any()]
        ends.append(sum(v.size[0] * v.size[1] for v in wedges))
        scales.append(scale)
    return Decimated(shape, wedges, np.array(ends), np.array(scales))


def forward(shape: tuple[int, int], kind: str):
    """(forward, inverse, thresholded) on slices of the shape."""
    w = windows(shape, kind)

    def fwd(x):
        return np.fft.ifft2(np.fft.fft2(x) * w)

    def inv(c):
        return np.fft.ifft2((np.fft.fft2(c) * w).sum(axis=0))

    return fwd, inv, lambda c, f: f(c)
