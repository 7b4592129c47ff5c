"""Slices cut into bands and strips against the kernel on whole slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid import layouts
from echogrid.kernels.pocs import pocs
from echogrid.operators import bands
from echogrid.plans import adapters, queries, steps

SF = "/root/testdata/sf0.001"
N_IL, N_XL = 10, 13


@pytest.fixture(scope="module")
def cut(spark):
    """Three slices, one of zeros, in tiles of 4 x 4, and the arrays."""
    r = np.random.default_rng(0)
    mask = (r.random((N_IL, N_XL)) > 0.4).astype(float)
    x = [r.normal(size=(N_IL, N_XL)) * mask for _ in range(2)] + [np.zeros((N_IL, N_XL))]
    shape = bands.Shape(N_IL, N_XL, 4, 4)
    rows = [(i, il + 1, xl + 1, float(x[i][il, xl])) for i in range(3) for il in range(N_IL) for xl in range(N_XL) if mask[il, xl] and (x[i][il, xl] or il < 2)]
    rows += [(0, 1, 1, 1e9)]  # of repeated bins the least counts
    x[0][0, 0], mask[0, 0] = min(x[0][0, 0], 1e9) if mask[0, 0] else 1e9, 1.0
    samples = spark.createDataFrame(rows, "i int, il int, xl int, amp double")
    bins = spark.createDataFrame([(il + 1, xl + 1, int(mask[il, xl])) for il in range(N_IL) for xl in range(N_XL)], "il int, xl int, fold int")
    return shape, x, mask, bands.to_bands(samples, shape), bands.mask_of(bins, shape)


def grids(rows, shape):
    out = {}
    for r in rows:
        g = out.setdefault(r.slice, np.zeros((N_IL, N_XL), complex))
        g[r.band * shape.height : r.band * shape.height + shape.height] = (np.array(r.re) + 1j * np.array(r.im)).reshape(-1, N_XL)
    return out


def test_transform_over_both_axes(spark, cut):
    shape, x, _, b, _ = cut
    got = {}
    for r in bands.spectrum(b, shape).collect():
        g = got.setdefault(r.slice, np.zeros((N_IL, N_XL), complex))
        v = (np.array(r.re) + 1j * np.array(r.im)).reshape(-1, N_IL).T
        g[:, r.strip * 4 : r.strip * 4 + v.shape[1]] = v
    assert all(np.allclose(got[i], np.fft.fft2(x[i]), atol=1e-12) for i in range(3))
    sizes = {r.slice: r for r in bands.sizes(bands.spectrum(b, shape), True).collect()}
    c = np.fft.fft2(x[1]).ravel()
    assert (sizes[1].large, sizes[1].low, sizes[1].n) == (pytest.approx(np.abs(c).max()), pytest.approx(np.abs(c).min()), N_IL * N_XL)
    assert sizes[1].top == pytest.approx(np.max(c).real) and sizes[1].squares == pytest.approx((np.abs(c) ** 2).sum())


@pytest.mark.parametrize(
    "options",
    [
        {"niter": 30, "eps": 1e-2, "thresh_op": "soft", "version": "fast"},
        {"niter": 5, "transform": "DCT", "version": "adaptive", "alpha": 0.8, "p_min": "adaptive", "thresh_op": "garrote", "thresh_model": "linear"},
        {"niter": 5, "thresh_model": "inverse_proportional-2", "compat_cost": True, "compat_lexmax": True, "sqrt_decay": True},
    ],
)
def test_interpolation(cut, options):
    shape, x, mask, b, m = cut
    rows = bands.interpolate(b, m, shape, **options).collect()
    got = grids(rows, shape)
    for i in range(3):
        want = pocs(x[i], mask, **options)
        mine = next(r for r in rows if r.slice == i)
        assert np.abs(got[i] - want.grid).max() < 1e-9 * max(1, np.abs(x[i]).max()) and mine.niter == want.niter
        assert mine.cost == pytest.approx(want.cost, rel=1e-6, abs=1e-15)


def test_what_needs_whole_slices_is_refused(cut):
    shape, _, _, b, m = cut
    for options in ({"thresh_op": "hard-percentile"}, {"thresh_model": "data-driven"}, {"transform": "WAVELET"}, {"version": "other"}):
        with pytest.raises(ValueError):
            bands.interpolate(b, m, shape, **options)


def test_query_agrees_with_whole_slices(spark):
    from echogrid.operators import pocs as whole

    got = {(r.slice, r.il, r.xl): (r.amp, r.niter) for r in queries.QUERIES["j1_pocs_bands"](spark, SF).collect()}
    c = adapters.cube(spark, SF)
    n_il, n_xl = adapters.extent(c)
    long = layouts.to_samples(c).select("il", "xl", "i", (F.col("amp") * F.col("fold")).alias("amp"))
    want = whole.interpolate(layouts.to_slices(long, n_il, n_xl), whole.mask_of(c, n_il, n_xl), niter=5)
    rows = layouts.from_slices(want).join(want.select("slice", "niter"), "slice").collect()
    assert len(rows) == len(got) and all(abs(got[r.slice, r.il, r.xl][0] - r.amp) < 1e-4 and got[r.slice, r.il, r.xl][1] == r.niter for r in rows)


def test_step_of_large_slices(spark):
    """Complex frequency slices in bands, and back to the time of full bins."""
    r = np.random.default_rng(2)
    cube = spark.createDataFrame([(il, xl, 1, r.normal(size=16).tolist()) for il in range(1, 6) for xl in range(1, 8)], "il int, xl int, fold int, samples array<double>")
    spec = steps.to_frequency(cube.select("il", "xl", "samples"), 0.05)
    full = steps.interpolate_large(spec, cube, 5, 7, values=16, niter=3)
    assert {c for c in full.columns} == {"i", "il", "xl", "re", "im", "niter", "cost"}
    back = {(r.il, r.xl): r.samples for r in steps.to_time_large(full, 0.05).collect()}
    assert all(np.allclose(back[r.il, r.xl], r.samples, atol=1e-9) for r in cube.collect())
