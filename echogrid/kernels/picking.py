"""Kernels over whole lines: seafloor picks, statics, despiking."""

from __future__ import annotations

import numpy as np

from . import dsp


def odd(n: float, least: int = 7) -> int:
    n = int(n)
    return max(n + (n % 2 == 0), least)


def mirrored(a: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(a) - 1)
    if n < 1:
        return a
    return np.r_[a[0] - np.abs(a[1 : n + 1][::-1] - a[0]), a, a[-1] - np.abs(a[-n - 1 : -1][::-1] - a[-1])]


def moving_median(a: np.ndarray, win: int) -> np.ndarray:
    p = mirrored(a, win // 2)
    w = min(win, len(p))
    return np.median(np.lib.stride_tricks.sliding_window_view(p, w), axis=1)[: len(a)]


def moving_mad_outliers(a: np.ndarray, win: int, threshold: float = 3.0) -> np.ndarray:
    """Rolling median absolute deviation on mirrored data; 0 counts as 1."""
    p = mirrored(np.asarray(a, float), win // 2)
    w = np.lib.stride_tricks.sliding_window_view(p, min(win, len(p)))
    med = np.median(w, axis=1)
    mad = np.median(np.abs(w - med[:, None]), axis=1)
    n = len(a)
    return np.abs(a - med[:n]) / np.where(mad[:n] == 0, 1, mad[:n]) > threshold


def cleaned(a: np.ndarray, win: int, threshold: float = 3.0) -> np.ndarray:
    """Rolling outliers replaced by a cubic spline; runs at both ends stay."""
    bad = moving_mad_outliers(a, win, threshold)
    good = np.flatnonzero(~bad)
    if len(good) < 4:
        return a
    bad[: good[0]] = bad[good[-1] + 1 :] = False
    out = np.asarray(a, float).copy()
    keep = np.flatnonzero(~bad)
    out[bad] = dsp.cubic_spline(keep.astype(float), out[keep], np.flatnonzero(bad).astype(float))
    return out


def seafloor(data: np.ndarray, nsta: int | None = None, nlta: int | None = None, win: int = 30, threshold: float | None = None, win_mad: int | None = None, win_median: int = 11, n: int = 5, post: bool = True, start: np.ndarray | None = None) -> np.ndarray:
    """Sample number of the seafloor in each trace (rows) of a line.

    Energy ratio of a short to a long trailing window; its first sample above
    the threshold, by default the largest value that any trace has in the
    second long window; outliers along the line removed; then the largest of
    the first contiguous group among the n largest amplitudes within `win`
    samples of it, both ends included. Zero traces are interpolated. start: the
    first sample of each trace that isn't padding; nothing before it is picked.
    """
    data = np.asarray(data, float)
    live = np.flatnonzero(np.abs(data).max(axis=1, initial=0) > 0)
    if not len(live):
        return np.zeros(len(data), int)
    x = data[live]
    ns = x.shape[1]
    begin = np.zeros(len(x), int) if start is None else np.asarray(start, int)[live]
    if begin.any():  # the padding is put behind the trace, so that windows of energy begin with data
        x = np.take_along_axis(x, (np.arange(ns) + begin[:, None]) % ns, axis=1)
    nsta = nsta or round(0.001 * ns)
    nlta = nlta or round(0.05 * ns)
    if nsta < 3:
        nsta, nlta = 3, 50
    nlta = min(nlta, ns // 2)
    c = np.cumsum(np.pad(x**2, ((0, 0), (1, 0))), axis=1)
    mean = lambda k: np.pad((c[:, k:] - c[:, :-k]) / k, ((0, 0), (k - 1, 0)))
    lta = mean(nlta)
    ratio = np.where(lta > 0, mean(nsta) / np.where(lta > 0, lta, 1), 0)
    ratio[:, : nlta - 1] = 0
    limit = threshold if threshold is not None else ratio[:, nlta : 2 * nlta].max()
    above = ratio > limit
    pick = np.where(above.any(axis=1), above.argmax(axis=1), -1).astype(float)
    found = pick[pick >= 0]
    pick[pick < 0] = np.median(found) if len(found) else 0
    pick = np.trunc(cleaned(pick, win_mad or odd(0.02 * len(x))))
    wm = win_median if win_median <= len(x) else odd(0.3 * len(x), 1)
    pick = np.clip(moving_median(pick, wm).astype(int), 0, ns - 1)
    out = np.zeros(len(x))
    for i, p in enumerate(pick):
        lo, hi = max(0, p - win), min(ns, p + win + 1)
        top = np.sort(np.argsort(-x[i, lo:hi], kind="stable")[:n])
        breaks = np.flatnonzero(np.diff(top) > 1)
        group = top[: breaks[0] + 1] if len(breaks) else top
        out[i] = begin[i] + lo + group[np.argmax(x[i, lo:hi][group])]
    full = np.interp(np.arange(len(data)), live, out)
    if post:
        full = cleaned(full, odd(0.01 * len(x)))
    return np.rint(full).astype(int)


def static(picks: np.ndarray, kind: str = "diff", win_mad: int | None = None, win_sg: int = 7, limit_percentile: float | None = None, limit_samples: float | None = 12, limit_mad: float | None = 3.0, depressions: tuple[int, float, float] | None = None) -> np.ndarray:
    """Shift of each trace: low-passed picks less the picks (diff), or the low-pass's second derivative (deriv).

    depressions = (traces at each side, limit at the edge, limit in the middle)
    bounds the shift over valleys of the seafloor, so that they aren't filled;
    the other limits are applied in any case.
    """
    clean = cleaned(np.asarray(picks, float), win_mad or odd(0.05 * len(picks)))
    s = dsp.savgol(clean, win_sg, 1) - clean if kind == "diff" else dsp.savgol(clean, win_sg, min(win_sg - 2, 5), 2)
    if depressions is not None and len(clean) > 12:
        side, edge, middle = depressions
        low = dsp.savgol(clean, win_sg, 1)
        rest = -(low - dsp.polynomial(low, 11, "low"))
        med = np.median(rest)
        left = np.median(np.abs(rest[rest <= med] - med)) or 1.0
        valley = (rest < med) & (np.abs(rest - med) / left > 3)
        at = np.flatnonzero(valley)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(run) >= 3:
                a, b = max(0, run[0] - side), min(len(s), run[-1] + side + 1)
                mid = (a + b) // 2
                bound = np.interp(np.arange(a, b), [a, mid, b - 1], [edge, middle, edge])
                s[a:b] = np.clip(s[a:b], -bound, bound)
    if limit_percentile is not None:
        b = np.percentile(np.abs(s), limit_percentile)
        s = np.clip(s, -b, b)
    if limit_samples is not None:
        s = np.clip(s, -limit_samples, limit_samples)
    if limit_mad is not None:
        b = limit_mad * np.median(np.abs(s))
        s = np.clip(s, -b, b) if b > 0 else s
    return s


def despike(data: np.ndarray, window: float, dt: float, overlap: float = 10, ntraces: int = 5, mode: str = "mean", threshold: float = 2.0, out: str = "scaled") -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(edited copy, (trace, first, last) of what was replaced); data has traces in rows.

    In windows of time and an odd number of traces, a sample is a spike if its
    amplitude is above threshold times the statistic of its row over the
    traces. Only runs above 5 % of the window on traces with more than 10 % of
    spikes in a window count; they are widened by 10 % and replaced.
    """
    data = np.asarray(data, float)
    ntr, ns = data.shape
    win, h = max(1, int(window / dt)), ntraces // 2
    win = min(win, ns)
    stat = {"mean": lambda w: np.abs(w).mean(axis=-1), "median": lambda w: np.median(np.abs(w), axis=-1), "rms": lambda w: np.sqrt((w**2).mean(axis=-1))}[mode]
    step = max(1, win - max(1, round(overlap / 100 * win)))
    starts = sorted({*range(0, ns - win + 1, step), ns - win})
    edited, found = data.copy(), []
    for c in range(ntr):
        a = min(max(0, c - h), max(0, ntr - ntraces))
        s = stat(data[a : a + ntraces].T)
        hot = np.abs(data[c]) > threshold * s
        mark = np.zeros(ns, bool)
        for t in starts:
            if hot[t : t + win].sum() > 0.1 * win:
                mark[t : t + win] |= hot[t : t + win]
        at = np.flatnonzero(mark)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 0.05 * win) + 1) if len(at) else []:
            n = run[-1] - run[0] + 1
            if n <= 0.05 * win:
                continue
            lo, hi = max(0, run[0] - int(0.1 * n)), min(ns, run[-1] + int(0.1 * n) + 1)
            x = data[c, lo:hi]
            new = {
                "scaled": lambda x=x, lo=lo, hi=hi: x * s[lo:hi] / (np.abs(x).max() or 1),
                "mode": lambda x=x, lo=lo, hi=hi: np.sign(x) * s[lo:hi],
                "threshold": lambda x=x, lo=lo, hi=hi: np.sign(x) * np.minimum(np.abs(x), threshold * s[lo:hi]),
                "zeros": lambda x=x: np.zeros(len(x)),
                "median": lambda a=a, lo=lo, hi=hi: np.median(data[a : a + ntraces, lo:hi], axis=0),
            }[out]()
            edited[c, lo:hi] = new
            found.append((c, lo, hi - 1))
    return edited, found
