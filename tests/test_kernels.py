"""Kernels against closed forms, and properties that must hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echogrid.kernels import dsp, picking, pocs, slices, wavelets


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * np.asarray(f) / fs)
    return np.abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos], axis=0))


@pytest.mark.parametrize("order", [1, 2, 3, 6, 9])
def test_butterworth_response(order):
    f, w = np.array([2.0, 8, 10, 15, 30]), np.tan(np.pi * np.array([2.0, 8, 10, 15, 30]) / 100)
    c = np.tan(np.pi * 10 / 100)
    assert np.allclose(response(dsp.butter_sos(order, 10, "lowpass", 100), f, 100), 1 / np.sqrt(1 + (w / c) ** (2 * order)), atol=1e-6)
    assert np.allclose(response(dsp.butter_sos(order, 10, "highpass", 100), f, 100), 1 / np.sqrt(1 + (c / w) ** (2 * order)), atol=1e-6)
    a, b = np.tan(np.pi * 8 / 100), np.tan(np.pi * 20 / 100)
    q = (w**2 - a * b) / (w * (b - a))
    assert np.allclose(response(dsp.butter_sos(order, (8, 20), "bandpass", 100), f, 100), 1 / np.sqrt(1 + q ** (2 * order)), atol=1e-5)


def test_zero_phase_keeps_a_slow_wave_and_constants():
    t = np.arange(400)
    slow = np.sin(2 * np.pi * t * 2 / 100)
    y = dsp.butterworth(slow + np.sin(2 * np.pi * t * 40 / 100), "lowpass", 10, 100)
    assert np.abs(y - slow)[50:-50].max() < 1e-2
    assert np.allclose(dsp.butterworth(np.full(100, 3.0), "lowpass", 10, 100, 4), 3)
    n, wn = dsp.butter_order([10.0], [20.0], 100.0)
    h = response(dsp.butter_sos(n, wn, "lowpass", 100), [10, 20], 100)
    assert h[0] >= 10 ** (-1 / 20) - 1e-6 and h[1] <= 10 ** (-10 / 20) + 1e-6


@given(st.integers(2, 60), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_transforms_invert(n, seed):
    x = np.random.default_rng(seed).normal(size=2 * n)
    for real in (False, True):
        _, s = dsp.forward(x, 0.5, 3.0, real=real)
        assert np.allclose(dsp.backward(s, 0.5, 3.0, real=real), x)
    fwd, inv, _ = wavelets.forward((n, 7))
    g = np.random.default_rng(seed).normal(size=(n, 7))
    assert np.allclose(inv(fwd(g)), g)


def test_splines_and_fits():
    p = np.poly1d([1, -2, 3, 1])
    x = np.array([0, 0.5, 1.7, 2, 3.1, 4.4, 5])
    assert np.allclose(dsp.cubic_spline(x, p(x), np.linspace(0, 5, 21)), p(np.linspace(0, 5, 21)))
    assert np.allclose(dsp.savgol(p(np.arange(20.0)), 7, 3), p(np.arange(20.0)))
    assert np.allclose(dsp.savgol(p(np.arange(20.0)), 7, 3, 2), p.deriv(2)(np.arange(20.0)))
    assert np.allclose(dsp.polynomial(p(np.arange(20.0)), 3), 0, atol=1e-8)
    line = 2.0 * np.arange(30) + 1
    assert np.allclose(dsp.smooth(line, 7), line)


def test_resampling_keeps_a_wave():
    t = np.arange(64)
    w = np.sin(2 * np.pi * 3 * t / 64)
    assert np.allclose(dsp.resample(w, 128)[::2], w) and np.allclose(dsp.resample(w, 32), w[::2])
    y = dsp.resample_poly(np.sin(2 * np.pi * 3 * np.arange(640) / 640), 1, 2)
    assert np.abs(y - np.sin(2 * np.pi * 3 * np.arange(0, 640, 2) / 640))[30:-30].max() < 1e-2
    assert np.allclose(dsp.envelope(np.cos(2 * np.pi * 5 * t / 64)), 1)
    a = np.random.default_rng(0).normal(size=65)
    assert dsp.lag(dsp.cross_correlation(np.roll(a, 4), a)) == -4


def plane_waves():
    y, x = np.mgrid[:40, :48]
    g = np.sin(2 * np.pi * (2 * y / 40 + 3 * x / 48)) + 0.5 * np.cos(2 * np.pi * (5 * y / 40 - 2 * x / 48))
    return g, (np.random.default_rng(1).uniform(size=g.shape) > 0.5).astype(float)


@pytest.mark.parametrize("transform", pocs.TRANSFORMS)
@pytest.mark.parametrize("version", pocs.VERSIONS)
def test_pocs_recovers(transform, version):
    g, m = plane_waves()
    snr = lambda z: 10 * np.log10((g**2).sum() / ((z - g) ** 2).sum())
    r = pocs.pocs(g * m, m, 30, transform, version=version)
    assert snr(r.grid) > snr(g * m) + 8 and np.allclose(r.grid * m, g * m) and r.niter >= 4


def test_pocs_edges():
    g, _ = plane_waves()
    assert np.allclose(pocs.pocs(g, np.ones_like(g), 5).grid, g)
    z = pocs.pocs(np.zeros((4, 4)), np.ones((4, 4)))
    assert z.niter == 0 and not z.grid.any()
    c = pocs.pocs(g + 1j * g, np.ones_like(g), 5)
    assert np.iscomplexobj(c.grid)
    for bad in ({"mask": 2 * np.ones_like(g)}, {"version": "x"}, {"transform": "RIDGELET"}):
        with pytest.raises(ValueError):
            pocs.pocs(g, **({"mask": np.ones_like(g)} | bad))
    for model in ("linear", "exponential", "exponential-2", "inverse_proportional", "data-driven"):
        d = pocs.decay(model, 10, 0.99, 1e-3, np.fft.fft2(g))
        assert len(d) == 10 and (np.diff(d) <= 1e-9).all()


def test_slice_filters():
    g = np.random.default_rng(2).normal(size=(50, 50))
    assert abs(slices.noise_level(g) / (255 / (g.max() - g.min())) - 1) < 0.1
    assert np.allclose(slices.gaussian(np.ones((9, 9)), 1), 1) and np.allclose(slices.median(np.ones((5, 6))), 1)
    w = slices.footprint_filter((40, 60), sigma=2)
    assert w.shape == (40, 60) and w.min() >= -1e-9 and w.max() <= 1 + 1e-9
    striped = g + 3 * np.sin(2 * np.pi * 12 * np.arange(50) / 50)[:, None]
    out = slices.filtered(striped, slices.footprint_filter((50, 50), sigma=2, buffer_center=0.2))
    assert np.abs(np.fft.fft2(out)[12, 0]) < 0.5 * np.abs(np.fft.fft2(striped)[12, 0])


def test_despike_documented_example():
    data = np.ones((100, 5000)) + 0.1 * np.sin(np.arange(5000))
    data[50, 2000:2400] = 5
    edited, found = picking.despike(data, 30, 0.05, 10, 5, "mean", 2, "scaled")
    assert {c for c, _, _ in found} == {50} and np.abs(edited[50, 1960:2440]).max() <= 2.0
    assert np.array_equal(np.delete(edited, 50, 0), np.delete(data, 50, 0)) and data[50, 2100] == 5


def test_seafloor_and_static():
    rng = np.random.default_rng(4)
    true = (400 + 40 * np.sin(np.arange(120) / 15)).astype(int)
    data = np.abs(0.01 * rng.normal(size=(120, 1000)))
    for i, p in enumerate(true):
        data[i, p : p + 12] += np.hanning(14)[1:-1]
    data[60] = 0
    pick = picking.seafloor(data)
    assert np.median(np.abs(pick - true - 5)) <= 3
    noisy = true + rng.integers(-2, 3, 120)
    s = picking.static(noisy)
    assert np.abs(s).max() <= 12 and np.std(np.diff(noisy + s)) < np.std(np.diff(noisy))
    assert np.abs(picking.static(noisy, depressions=(5, 1, 2))).max() <= 12


def pattern(shape, sigma, ones):
    """Weights of a padded pattern of ones, by a direct convolution and plain loops."""
    pad = 5 * sigma
    m = np.zeros((shape[0] + pad, shape[1] + pad))
    for y, x in ones(*m.shape):
        m[y, x] = 1
    r = 4 * sigma
    g = [np.exp(-(d**2) / (2 * sigma**2)) for d in range(-r, r + 1)]
    out = np.zeros(shape)
    for y in range(shape[0]):
        for x in range(shape[1]):
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    yy, xx = y + pad // 2 - a, x + pad // 2 - b
                    if 0 <= yy < m.shape[0] and 0 <= xx < m.shape[1] and m[yy, xx]:
                        out[y, x] += g[a + r] * g[b + r]
    return (out - out.min()) / (out.max() - out.min())


def test_footprint_filter_by_loops():
    shape, keep, half = (14, 18), 0.25, 1

    def bars(direction):
        def ones(ny, nx):
            ly, lx = round(ny * (1 - keep) + 0.5) // 2, round(nx * (1 - keep) + 0.5) // 2
            for d in range(-half, half + 1):
                if direction in ("both", "iline"):
                    yield from ((y, nx // 2 + 1 + d) for y in [*range(ly), *range(ny - ly, ny)])
                if direction in ("both", "xline"):
                    yield from ((ny // 2 + 1 + d, x) for x in [*range(lx), *range(nx - lx, nx)])

        return ones

    for direction in ("both", "iline", "xline"):
        want = np.fft.ifftshift(1 - pattern(shape, 1, bars(direction)))
        assert np.allclose(slices.footprint_filter(shape, 1, direction, keep, half), want, atol=1e-9)
    f = lambda s, d: slices.footprint_filter(s, 1, d, keep, half)
    assert np.allclose(f((18, 14), "twt"), f((18, 14), "xline")) and np.allclose(f(shape, "twt"), f(shape, "iline"))
    # stripes along inlines change from inline to inline only: their wavenumbers lie on the column 0
    w = slices.footprint_filter((40, 60), 2, "iline")
    assert w[15, 0] < 0.1 and w[0, 20] > 0.9 and w[15, 30] > 0.9 and w[0, 0] > 0.5


def test_antialias_filter_by_loops():
    shape = (60, 40)
    for factors, direction in (((4, 1), "iline"), ((1, 3), "xline"), ((2, 1), None), ((1, 2), None)):
        axis = 0 if (direction or ("iline" if factors[0] > factors[1] else "xline")) == "iline" else 1
        out = round(shape[axis] * (1 - factors[1 - axis] / factors[axis]) * 0.98) // 2 + 5

        def ones(ny, nx, axis=axis, out=out):
            return [(y, x) for y in range(ny) for x in range(nx) if out <= (y, x)[axis] < (ny, nx)[axis] - out]

        want = np.fft.ifftshift(1e-3 + 0.999 * pattern(shape, 1, ones))
        got = slices.antialias_filter(shape, factors, direction, 1)
        assert np.allclose(got, want, atol=1e-9) and got.min() >= 1e-3 - 1e-12


def test_filters_of_many_traces_at_once():
    x = np.random.default_rng(5).normal(size=(7, 90))
    sos = dsp.butter_sos(4, (2.0, 6.0), "bandpass", 20.0)
    both = dsp.sosfiltfilt(sos, x)
    assert both.shape == x.shape and all(np.allclose(both[i], dsp.sosfiltfilt(sos, x[i])) for i in range(7))
    assert np.allclose(dsp.agc(np.zeros((2, 9)), 5), 0)
    for kind in ("rms", "mean", "median"):
        got = dsp.agc(x, 5, kind)
        p = np.pad(x, ((0, 0), (2, 2)))
        for i in range(7):
            for k in range(90):
                w = p[i, k : k + 5]
                g = {"rms": np.sqrt((w**2).mean()), "mean": w.mean(), "median": np.median(w)}[kind]
                assert np.isclose(got[i, k], x[i, k] / (g or 1), rtol=1e-6)
        assert np.allclose(dsp.agc(x, 5, kind, True), np.sign(got) * got**2)


def test_interpolation_kinds():
    x = np.array([0.0, 1, 4, 5, 7, 9])
    at = np.linspace(0, 9, 37)
    line, parabola, cubic = 2 * x - 3, x**2 - 4 * x, x**3 - x
    assert np.allclose(dsp.interpolated(x, line, at, "slinear"), 2 * at - 3)
    assert np.allclose(dsp.interpolated(x, parabola, at, "quadratic"), at**2 - 4 * at)
    assert np.allclose(dsp.interpolated(x, cubic, at, "cubic"), at**3 - at)
    y = np.array([1.0, 5, 2, 2, 8, 0])
    assert np.allclose(dsp.interpolated(x, y, x, "quadratic"), y) and dsp.interpolated(x, y, np.array([3.9, 4.0]), "zero").tolist() == [5, 2]
    assert np.allclose(dsp.interpolated(x[:3], y[:3], x[:3], "quadratic"), y[:3]) and np.allclose(dsp.interpolated(x[:2], y[:2], np.array([0.5]), "quadratic"), 3)
    with pytest.raises(ValueError):
        dsp.interpolated(x, y, at, "nope")


def test_seafloor_window_reaches_both_ends():
    data = np.full((30, 400), 0.01)
    data[:, 200:203] = 1.0  # what the energy ratio finds first
    data[:, 230] = 9.0
    found = picking.seafloor(data, win=30, n=1, post=False, threshold=5.0)
    at = found[0]
    assert (found == at).all() and at in (200, 230)
    first = [p for p in range(170, 231) if picking.seafloor(data, win=230 - p, n=1, post=False, threshold=5.0)[0] == 230]
    assert first and max(first) == 200  # a window of exactly the distance holds the peak
    padded = np.pad(data, ((0, 0), (50, 0)))
    assert (picking.seafloor(padded, win=30, n=1, post=False, threshold=5.0, start=np.full(30, 50)) == at + 50).all()


@pytest.mark.parametrize("kind", ["SHEARLET", "CURVELET"])
def test_directional_frames(kind):
    from echogrid.kernels import frames

    for shape in ((16, 16), (10, 59), (33, 20)):
        w = frames.windows(shape, kind)
        assert len(w) > 4 and np.allclose((w**2).sum(axis=0), 1)
        fwd, inv, shrink = frames.forward(shape, kind)
        x = np.random.default_rng(3).normal(size=shape)
        assert np.allclose(inv(fwd(x)), x) and np.allclose(inv(shrink(fwd(x), lambda c: 2 * c)), 2 * x)
        assert np.isclose((np.abs(fwd(x)) ** 2).sum(), (x**2).sum())
    # a plane wave lies in few windows, those of its direction
    wave = np.cos(2 * np.pi * (6 * np.arange(64)[:, None] + 18 * np.arange(64)) / 64)
    energy = np.sort((np.abs(frames.forward((64, 64), kind)[0](wave)) ** 2).sum(axis=(1, 2)))[::-1]
    assert energy[:4].sum() > 0.99 * energy.sum()
    with pytest.raises(ValueError):
        frames.windows((8, 8), "x")
    # gaps in a plane wave are filled
    mask = (np.random.default_rng(1).random((64, 64)) > 0.4).astype(float)
    got = pocs.pocs(wave * mask, mask, 30, kind, thresh_model="exponential", p_max=0.9, p_min=1e-3)
    assert np.abs(got.grid - wave)[mask == 0].mean() < 0.3 * np.abs(wave)[mask == 0].mean()
    assert np.allclose(got.grid[mask == 1], wave[mask == 1])


@pytest.mark.parametrize("kind", ["SHEARLET", "CURVELET"])
@pytest.mark.parametrize("shape", [(64, 64), (33, 50), (96, 40), (8, 9)])
def test_decimated_frames(kind, shape):
    """The slice comes back, energies stay, coefficients are few, and each wedge's are the window's own at coarser places."""
    from echogrid.kernels import frames

    rng = np.random.default_rng(1)
    f = frames.decimated(shape, kind)
    for x in (rng.normal(size=shape), rng.normal(size=shape) + 1j * rng.normal(size=shape)):
        c = f.forward(x)
        assert np.abs(f.inverse(c) - x).max() < 1e-10 and np.isclose((np.abs(c) ** 2).sum(), (np.abs(x) ** 2).sum())
    assert len(c) == f.ends[-1] and (min(shape) < 32 or len(c) <= 8 * x.size)
    for w in f.wedges:
        assert len(np.unique(w.to)) == len(w.to) == len(np.unique(w.at))  # wrapping is one to one
    # energies by window are those of the frame that isn't decimated
    whole = (np.abs(frames.forward(shape, kind)[0](x)) ** 2).sum(axis=(1, 2))
    assert np.allclose([(np.abs(c[a:b]) ** 2).sum() for a, b in zip(f.ends, f.ends[1:], strict=False)], whole)


def test_thresholds_of_windows():
    """Each window's thresholds run from its own largest coefficient; the adaptive floor weighs the scales."""
    from echogrid.kernels import frames, pocs

    rng = np.random.default_rng(2)
    x = rng.normal(size=(32, 32))
    f = frames.decimated((32, 32), "SHEARLET")
    c = f.forward(x)
    parts = [np.abs(c[a:b]) for a, b in zip(f.ends, f.ends[1:], strict=False)]
    t = pocs.window_decays(f, c, "linear", 5, 0.9, 0.1, "values", False)
    assert np.allclose(t[0], [0.9 * p.max() for p in parts]) and np.allclose(t[-1], [0.1 * p.max() for p in parts])
    floor = np.median([np.log10(j + 1) * np.sqrt((p**2).sum() / len(c)) for j, p in zip(f.scales, parts, strict=True)]) / 3
    assert np.allclose(pocs.window_decays(f, c, "exponential", 4, 0.9, "adaptive", "values", False)[-1], floor)
    wave = np.cos(np.arange(32) * 0.4)[None, :] + np.cos(np.arange(32) * 0.3)[:, None]
    mask = (rng.random((32, 32)) > 0.3).astype(float)
    for kind, options in (("SHEARLET", {}), ("SHEARLET", {"per_window": True}), ("CURVELET", {}), ("SHEARLET", {"per_window": True, "p_min": "adaptive"}), ("SHEARLET", {"per_window": True, "thresh_op": "soft-percentile", "decay_kind": "factors", "p_max": 99.0, "p_min": 60.0, "thresh_model": "linear"})):
        got = pocs.pocs(wave * mask, mask, niter=25, transform=kind, **options)
        assert np.allclose(got.grid[mask > 0], wave[mask > 0])
        assert "thresh_op" in options or np.abs(got.grid - wave).mean() < 0.6 * np.abs(wave * (1 - mask)).mean()
    with pytest.raises(ValueError):
        pocs.pocs(wave, mask, transform="CURVELET", per_window=True)
