"""Signals: analytic envelope, spectra, Butterworth filters, resampling, splines, polynomial smoothing."""

from __future__ import annotations

import numpy as np


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(np.asarray(x, float))) if len(x) else np.zeros(0)


def blackman(n: int) -> np.ndarray:
    return np.blackman(n)


def spectrum(x: np.ndarray, fs: float, n: int | None = None, taper: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, 2 |rfft| / sum of the taper)."""
    x = np.asarray(x, float)
    n = n or len(x)
    w = np.blackman(len(x)) if taper else np.ones(len(x))
    return np.fft.rfftfreq(n, 1 / fs), np.abs(np.fft.rfft(x * w, n)) * 2 / w.sum()


def forward(x: np.ndarray, dt: float, t0: float = 0.0, upsampling: int = 1, real: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(f, F) with F(f) = dt * sum of x_n exp(-2 pi i f t_n): true phase and amplitude. An odd last sample is dropped."""
    x = np.asarray(x, float)[: len(x) - len(x) % 2]
    n = len(x) * upsampling
    f = np.fft.rfftfreq(n, dt) if real else np.fft.fftfreq(n, dt)
    return f, (np.fft.rfft(x, n) if real else np.fft.fft(x, n)) * dt * np.exp(-2j * np.pi * f * t0)


def backward(spec: np.ndarray, dt: float, t0: float = 0.0, n: int | None = None, real: bool = False) -> np.ndarray:
    """The inverse of forward(); the first n samples."""
    size = 2 * (len(spec) - 1) if real else len(spec)
    f = np.fft.rfftfreq(size, dt) if real else np.fft.fftfreq(size, dt)
    s = spec / dt * np.exp(2j * np.pi * f * t0)
    x = np.fft.irfft(s, size) if real else np.fft.ifft(s).real
    return x[: n or size]


def butter_sos(order: int, cutoff, kind: str, fs: float) -> np.ndarray:
    """Second-order sections of a Butterworth filter: analogue prototype, band transform, bilinear transform."""
    w = np.atleast_1d(np.asarray(cutoff, float)) / (fs / 2)
    if (w <= 0).any() or (w >= 1).any():
        raise ValueError("cutoff frequencies must lie between 0 and half the sampling frequency")
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z, k, warped = np.zeros(0, complex), 1.0, 4 * np.tan(np.pi * w / 2)
    if kind == "lowpass":
        p, k = p * warped[0], warped[0] ** order
    elif kind == "highpass":
        k = 1 / np.prod(-p).real
        p, z = warped[0] / p, np.zeros(order, complex)
    elif kind in ("bandpass", "bandstop"):
        bw, w0 = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if kind == "bandpass":
            s = p * bw / 2
            p, z, k = np.r_[s + np.sqrt(s**2 - w0**2), s - np.sqrt(s**2 - w0**2)], np.zeros(order, complex), bw**order
        else:
            k = 1 / np.prod(-p).real
            s = bw / 2 / p
            p, z = np.r_[s + np.sqrt(s**2 - w0**2), s - np.sqrt(s**2 - w0**2)], np.r_[np.full(order, 1j * w0), np.full(order, -1j * w0)]
    else:
        raise ValueError(f"unknown filter {kind!r}")
    k *= (np.prod(4 - z) / np.prod(4 - p)).real
    zd, pd = np.r_[(4 + z) / (4 - z), -np.ones(len(p) - len(z))], (4 + p) / (4 - p)
    return _sections(zd, pd, k)


def _pairs(r: np.ndarray) -> list[np.ndarray]:
    """Conjugate pairs, then real roots two by two."""
    upper = r[r.imag > 1e-10]
    real = np.sort(r[np.abs(r.imag) <= 1e-10].real)
    out = [np.array([x, x.conj()]) for x in upper[np.argsort(-np.abs(upper))]]
    return out + [real[i : i + 2].astype(complex) for i in range(0, len(real), 2)]


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    poles, zeros = _pairs(p), _pairs(z)
    n = max(len(poles), len(zeros))
    sos = np.zeros((n, 6))
    zeros = sorted(zeros, key=lambda x: abs(x[0].imag))
    for i in range(n):
        b = np.poly(zeros[i]).real if i < len(zeros) else np.ones(1)
        a = np.poly(poles[i]).real if i < len(poles) else np.ones(1)
        sos[i, : len(b)], sos[i, 3 : 3 + len(a)] = b, a
    sos[0, :3] *= k
    return sos


def sosfilt(sos: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> np.ndarray:
    """Sections one after the other along the last axis; all traces of a matrix (traces x samples) at once. zi: states (section, 2, traces)."""
    y = np.array(x, float).T.copy()  # a sample's values of all traces lie together
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        z0, z1 = (np.zeros(y.shape[1:]), np.zeros(y.shape[1:])) if zi is None else zi[s]
        for i, v in enumerate(y):
            o = b0 * v + z0
            z0, z1 = b1 * v - a1 * o + z1, b2 * v - a2 * o
            y[i] = o
    return y.T


def sos_steady(sos: np.ndarray) -> np.ndarray:
    """States that a constant input of one leaves unchanged."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        g = (b0 + b1 + b2) / (1 + a1 + a2)
        out[s] = level * np.array([g - b0, b2 - a2 * g])
        level *= g
    return out


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward along the last axis, with odd extension at both ends."""
    n = 2 * len(sos) + 1
    n -= min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * n, x.shape[-1] - 1)
    first, last = x[..., :1], x[..., -1:]
    ext = np.concatenate([2 * first - x[..., pad:0:-1], x, 2 * last - x[..., -2 : -pad - 2 : -1]], axis=-1)
    zi = sos_steady(sos)
    start = lambda v: zi[..., None] * v if v.ndim else zi * v
    y = sosfilt(sos, ext, start(ext[..., 0]))
    y = sosfilt(sos, y[..., ::-1], start(y[..., -1]))[..., ::-1]
    return y[..., pad : y.shape[-1] - pad]


def agc(x: np.ndarray, win: int, kind: str = "rms", squared: bool = False) -> np.ndarray:
    """Traces x samples over a centred window of `win` samples, zeros beyond the ends; 1 instead of a gain of 0."""
    h = win // 2
    p = np.pad(x, ((0, 0), (h, h)))
    if kind == "median":
        g = np.median(np.lib.stride_tricks.sliding_window_view(p, win, axis=1), axis=2)
    else:
        c = np.cumsum(np.pad(p**2 if kind == "rms" else p, ((0, 0), (1, 0))), axis=1)
        g = (c[:, win:] - c[:, :-win]) / win
        g = np.sqrt(np.maximum(g, 0)) if kind == "rms" else g
    y = x / np.where(g == 0, 1, g)
    return np.sign(y) * y**2 if squared else y


def interpolated(x: np.ndarray, y: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Values at `at` from points (x, y) by rising x: zero (the last before), slinear, quadratic or cubic splines through all points."""
    if len(x) < 2 or kind == "zero":
        return y[np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 1)]
    if kind == "slinear" or len(x) == 2:
        k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
        return y[k] + (at - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])
    if kind == "cubic":
        return cubic_spline(x, y, at)
    if kind != "quadratic":
        raise ValueError(f"unknown kind {kind!r}")
    # pieces meet halfway between inner points, where value and slope agree; the outermost pieces reach to the third point
    n = len(x)
    edges = np.r_[x[0], (x[1:-2] + x[2:-1]) / 2, x[-1]] if n > 3 else np.array([x[0], x[-1]])
    knots = np.r_[[x[0]] * 3, edges[1:-1], [x[-1]] * 3]
    b = _quadratic_basis(knots, x)
    return _quadratic_basis(knots, np.clip(at, x[0], x[-1])) @ np.linalg.solve(b, y)


def _quadratic_basis(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at x of the quadratic B-splines on the knots t, by the recursion over degrees."""
    last = np.flatnonzero(t < t[-1])[-1]
    piece = np.clip(np.searchsorted(t, x, "right") - 1, 0, last)
    b = np.zeros((len(x), len(t) - 1))
    b[np.arange(len(x)), piece] = 1
    for d in (1, 2):
        new = np.zeros((len(x), len(t) - 1 - d))
        for i in range(new.shape[1]):
            for width, sign, j in ((t[i + d] - t[i], 1, i), (t[i + d + 1] - t[i + 1], -1, i + 1)):
                if width > 0:
                    new[:, i] += (x - t[i] if sign > 0 else t[i + d + 1] - x) / width * b[:, j]
        b = new
    return b


def butterworth(x: np.ndarray, kind: str, cutoff, fs: float, order: int = 9) -> np.ndarray:
    return sosfiltfilt(butter_sos(order, cutoff, kind, fs), np.asarray(x, float))


def butter_order(passband, stopband, fs: float, gpass: float = 1.0, gstop: float = 10.0) -> tuple[int, np.ndarray]:
    """Least order, and natural frequencies, that lose at most gpass dB in the pass band and at least gstop dB in the stop band."""
    wp, ws = (np.tan(np.pi * np.atleast_1d(np.asarray(v, float)) / fs) for v in (passband, stopband))
    if len(wp) == 1:
        low = wp[0] < ws[0]
        nat = ws / wp if low else wp / ws
    else:
        nat = np.abs((ws**2 - wp[0] * wp[1]) / (ws * (wp[0] - wp[1])))
    g = (10 ** (gstop / 10) - 1) / (10 ** (gpass / 10) - 1)
    order = max(1, int(np.ceil(np.log10(g) / (2 * np.log10(nat.min())))))
    w0 = (10 ** (gpass / 10) - 1) ** (-1 / (2 * order))
    if len(wp) == 1:
        wn = wp * w0 if low else wp / w0
    else:
        r = np.array([-w0, w0])
        wn = np.sort(np.abs(-r * (wp[1] - wp[0]) / 2 + np.sqrt(r**2 / 4 * (wp[1] - wp[0]) ** 2 + wp[0] * wp[1])))
    return order, np.arctan(wn) * fs / np.pi


def filter_frequency(x: np.ndarray, freqs, fs: float, kind: str, gpass: float = 1.0, gstop: float = 10.0) -> np.ndarray:
    """freqs: pass and stop frequency (lowpass), stop and pass (highpass), or stop, pass, pass, stop (bandpass)."""
    f = list(freqs)
    p, s = {"lowpass": (f[:1], f[1:2]), "highpass": (f[1:2], f[:1]), "bandpass": (f[1:3], [f[0], f[-1]])}[kind]
    order, wn = butter_order(p, s, fs, gpass, gstop)
    return butterworth(x, kind, wn, fs, order)


def resample(x: np.ndarray, num: int, window: np.ndarray | None = None) -> np.ndarray:
    """Fourier method: the spectrum is cut or filled with zeros; the frequency shared by both halves is kept balanced."""
    x = np.asarray(x, float)
    n = len(x)
    s = np.fft.rfft(x)
    if window is not None:
        s = s * window[: len(s)]
    m = min(n, num)
    y = np.zeros(num // 2 + 1, complex)
    k = m // 2 + 1
    y[:k] = s[:k]
    if m % 2 == 0 and num != n:
        y[m // 2] *= 2 if num < n else 0.5
    return np.fft.irfft(y, num) * (num / n)


def resample_poly(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Zero-stuffing, a Hann-windowed sinc low-pass, every down-th sample."""
    x = np.asarray(x, float)
    g = np.gcd(up, down)
    up, down = up // g, down // g
    if up == down == 1:
        return x.copy()
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(2 * half + 1)
    h *= up / h.sum()
    z = np.zeros(len(x) * up)
    z[::up] = x
    return np.convolve(z, h)[half : half + len(z)][::down][: -(-len(x) * up // down)]


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline; fewer than four knots give the polynomial through them."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a = np.zeros((3, n))
    r = np.zeros(n)
    a[0, 2:], a[1, 1:-1], a[2, :-2] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    r[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    a[1, 0], a[0, 1] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[1, -1], a[2, -2] = h[-2], h[-1] + h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    up, mid, low = a[0].copy(), a[1].copy(), a[2]
    for i in range(1, n):  # tridiagonal elimination
        f = low[i - 1] / mid[i - 1]
        mid[i] -= f * up[i]
        r[i] -= f * r[i - 1]
    s = np.zeros(n)
    s[-1] = r[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        s[i] = (r[i] - up[i + 1] * s[i + 1]) / mid[i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[k]
    c2, c3 = (3 * d[k] - 2 * s[k] - s[k + 1]) / h[k], (s[k] + s[k + 1] - 2 * d[k]) / h[k] ** 2
    return y[k] + t * (s[k] + t * (c2 + t * c3))


def savgol(x: np.ndarray, win: int, order: int, deriv: int = 0) -> np.ndarray:
    """Least-squares polynomials in centred windows; the outermost window's polynomial at both ends."""
    x = np.asarray(x, float)
    h = win // 2
    if len(x) < win:
        return x.copy()
    c = np.linalg.pinv(np.vander(np.arange(-h, h + 1), order + 1, increasing=True))[deriv] * np.prod(np.arange(1, deriv + 1))
    y = np.r_[np.zeros(h), np.convolve(x, c[::-1], "valid"), np.zeros(h)]
    for part, where in ((x[:win], np.arange(h)), (x[-win:], np.arange(win - h, win))):
        p = np.polynomial.polynomial.polyfit(np.arange(win), part, order)
        for _ in range(deriv):
            p = np.polynomial.polynomial.polyder(p)
        v = np.polynomial.polynomial.polyval(where, p)
        if where[0] == 0:
            y[:h] = v
        else:
            y[-h:] = v
    return y


def polynomial(x: np.ndarray, order: int = 3, kind: str = "high") -> np.ndarray:
    """low: the polynomial fitted to the index; high: what is left without it."""
    i = np.arange(len(x))
    fit = np.polynomial.Polynomial.fit(i, x, min(order, max(len(x) - 1, 0)))(i)
    return x - fit if kind == "high" else fit


def window(name: str, n: int) -> np.ndarray:
    return {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}[name](n)


def smooth(x: np.ndarray, win: int = 11, name: str = "hanning") -> np.ndarray:
    """Weighted moving mean of the same length; both ends go on along the line fitted to their win // 2 values."""
    x = np.asarray(x, float)
    if win < 3:
        return x
    if len(x) < win:
        raise ValueError("fewer values than the window")
    h = win // 2
    line = lambda part, at: np.polyval(np.polyfit(np.arange(len(part)), part, 1 if len(part) > 1 else 0), at)
    ext = np.r_[line(x[:h], np.arange(-h, 0)), x, line(x[-h:], np.arange(h, 2 * h))]
    w = window(name, win)
    y = np.convolve(ext, w / w.sum(), "same")
    return y[h : h + len(x)]


def cross_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mode 'same', by FFT."""
    n = len(a) + len(b) - 1
    full = np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b[::-1], n), n)
    start = (len(b) - 1) // 2
    return full[start : start + len(a)]


def lag(cc: np.ndarray) -> int:
    """floor(n / 2) - argmax, or argmin where the trough is deeper than the peak is high."""
    at = int(cc.argmin() if abs(cc.min()) > abs(cc.max()) else cc.argmax())
    return len(cc) // 2 - at
