"""Slices that are too large for one task: bands of rows, and transforms over both axes by shuffles of tiles.

A band row holds `height` rows of a slice: (slice, band, re, im) with re and im
in row-major order. A transform over both axes is one over the rows of each
band, a shuffle of tiles, and one over the columns of each strip of `width`
columns. A task holds a band (height x n_xl) or a strip (n_il x width), never a
slice, and every shuffle moves each value once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.pocs import VERSIONS, _dct, decay, threshold
from ..shared import forget, written

BANDS = "slice long, band int, re array<double>, im array<double>"
TILES = "slice long, band int, strip int, re array<double>, im array<double>"
TRANSFORMS = ("FFT", "DCT")
#: Threshold models that need no more than the largest, the least and the mean square coefficient.
MODELS = ("linear", "exponential", "inverse_proportional")


@dataclass(frozen=True)
class Shape:
    """A slice of n_il x n_xl bins, cut into bands of `height` rows and strips of `width` columns."""

    n_il: int
    n_xl: int
    height: int
    width: int

    @classmethod
    def of(cls, n_il: int, n_xl: int, values: int = 1 << 22) -> Shape:
        """Bands and strips of about so many values (4 million complex ones are 64 MB)."""
        return cls(n_il, n_xl, max(1, min(n_il, values // max(n_xl, 1))), max(1, min(n_xl, values // max(n_il, 1))))

    def rows(self, band: int) -> int:
        return min(self.height, self.n_il - band * self.height)

    def columns(self, strip: int) -> int:
        return min(self.width, self.n_xl - strip * self.width)

    @property
    def bands(self) -> int:
        return -(-self.n_il // self.height)

    @property
    def strips(self) -> int:
        return -(-self.n_xl // self.width)


def _axis(kind: str, n: int) -> tuple[Callable, Callable]:
    """Transform and inverse of rows of n values, orthogonal as the kernels' are."""
    if kind == "FFT":
        return (lambda x: np.fft.fft(x, axis=1)), (lambda x: np.fft.ifft(x, axis=1))
    if kind == "DCT":
        c = _dct(n)
        return (lambda x: x @ c.T), (lambda x: x @ c)
    raise ValueError(f"transform {kind!r} is none of {', '.join(TRANSFORMS)}")


def _array(row: pa.Array) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _complex(re: pa.Array, im: pa.Array) -> np.ndarray:
    return _array(re) + 1j * _array(im)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ravel(v) for v in values], pa.list_(pa.float64()))


def to_bands(samples: DataFrame, shape: Shape, value: str = "amp", imag: str | None = None) -> DataFrame:
    """Rows (il, xl, i, value[, imag]), il and xl from 1, to bands of slice i; bins without a row are zero, of repeated ones the least counts."""
    at = ((F.col("il") - 1) % shape.height * shape.n_xl + F.col("xl") - 1).cast("long")
    v = F.struct(F.col(value).cast("double").alias("re"), (F.col(imag).cast("double") if imag else F.lit(0.0)).alias("im"))
    d = samples.select(F.col("i").cast("long").alias("slice"), F.floor((F.col("il") - 1) / shape.height).cast("int").alias("band"), at.alias("k"), v.alias("v"))
    # every band of every slice, so that empty ones are there too; repeated bins are merged before the shuffle
    least = d.groupBy("slice", "band", "k").agg(F.min("v").alias("v"))
    grid = d.select("slice").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(shape.bands - 1)))).select("slice", "band", F.lit(-1).cast("long").alias("k"), F.lit(None).cast("struct<re:double,im:double>").alias("v"))

    def build(t: pa.Table) -> pa.Table:
        band = t.column("band")[0].as_py()
        t = t.filter(pa.compute.greater_equal(t.column("k"), 0))
        k, v = t.column("k").to_numpy(), t.column("v").combine_chunks()
        out = []
        for name in ("re", "im"):
            x = np.zeros(shape.rows(band) * shape.n_xl)
            if len(k):
                x[k] = v.field(name).to_numpy(zero_copy_only=False)
            out.append(x)
        return pa.table({"re": _lists([out[0]]), "im": _lists([out[1]])})

    def keyed(key: tuple, t: pa.Table) -> pa.Table:
        made = build(t)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "band": pa.array([key[1].as_py()], pa.int32()), "re": made.column("re"), "im": made.column("im")})

    return least.unionByName(grid).groupBy("slice", "band").applyInArrow(lambda key, t: keyed(key, t), BANDS)


def mask_of(bins: DataFrame, shape: Shape, fold: str = "fold") -> DataFrame:
    """band, mask: 0 or 1 of each bin of rows (il, xl, fold), a row a band."""
    m = to_bands(bins.select("il", "xl", F.lit(0).alias("i"), (F.col(fold) > 0).cast("double").alias("m")), shape, "m")
    return m.select("band", F.col("re").alias("mask"))


def from_bands(bands: DataFrame, shape: Shape) -> DataFrame:
    """Bands to rows (slice, il, xl, amp, imag)."""
    e = bands.select("slice", "band", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    il = F.col("band") * shape.height + F.floor(F.col("k") / shape.n_xl) + 1
    return e.select("slice", il.cast("int").alias("il"), (F.col("k") % shape.n_xl + 1).cast("int").alias("xl"), F.col("v.re").alias("amp"), F.col("v.im").alias("imag"))


def _cut(x: np.ndarray, slice_: int, band: int, shape: Shape) -> pa.RecordBatch:
    """A band as its tiles."""
    tiles = [x[:, s * shape.width : s * shape.width + shape.columns(s)] for s in range(shape.strips)]
    n = len(tiles)
    return pa.RecordBatch.from_arrays([pa.array([slice_] * n, pa.int64()), pa.array([band] * n, pa.int32()), pa.array(range(n), pa.int32()), _lists([t.real for t in tiles]), _lists([t.imag for t in tiles])], names=["slice", "band", "strip", "re", "im"])


def _strip(t: pa.Table, shape: Shape) -> tuple[int, int, np.ndarray]:
    """slice, strip and the transposed values of a group of tiles."""
    d = t.combine_chunks()
    strip = d.column("strip")[0].as_py()
    x = np.zeros((shape.columns(strip), shape.n_il), complex)
    for i in range(d.num_rows):
        band = d.column("band")[i].as_py()
        v = _complex(d.column("re")[i], d.column("im")[i]).reshape(shape.rows(band), -1)
        x[:, band * shape.height : band * shape.height + len(v)] = v.T
    return d.column("slice")[0].as_py(), strip, x


def _tiles(x: np.ndarray, slice_: int, strip: int, shape: Shape) -> pa.Table:
    """A strip, transposed, as its tiles."""
    tiles = [x[:, b * shape.height : b * shape.height + shape.rows(b)].T for b in range(shape.bands)]
    n = len(tiles)
    return pa.table({"slice": pa.array([slice_] * n, pa.int64()), "band": pa.array(range(n), pa.int32()), "strip": pa.array([strip] * n, pa.int32()), "re": _lists([t.real for t in tiles]), "im": _lists([t.imag for t in tiles])})


def _joined(t: pa.Table, shape: Shape) -> tuple[int, int, np.ndarray]:
    """slice, band and values of the tiles of a band."""
    d = t.combine_chunks()
    band = d.column("band")[0].as_py()
    x = np.zeros((shape.rows(band), shape.n_xl), complex)
    for i in range(d.num_rows):
        s = d.column("strip")[i].as_py()
        x[:, s * shape.width : s * shape.width + shape.columns(s)] = _complex(d.column("re")[i], d.column("im")[i]).reshape(len(x), -1)
    return d.column("slice")[0].as_py(), band, x


def spectrum(bands: DataFrame, shape: Shape, kind: str = "FFT", source: Callable | None = None, columns: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """The transform over both axes as tiles (slice, strip, re, im), transposed: one row a strip.

    source makes the values of a band from its row; by default they are re + i im.
    """
    rows, _ = _axis(kind, shape.n_xl)
    make = source or (lambda b, i: _complex(b.column("re")[i], b.column("im")[i]))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                band = b.column("band")[i].as_py()
                yield _cut(rows(make(b, i).reshape(shape.rows(band), shape.n_xl)), b.column("slice")[i].as_py(), band, shape)

    def column(t: pa.Table) -> pa.Table:
        along, _ = _axis(kind, shape.n_il)
        s, strip, x = _strip(t, shape)
        x = along(x)
        return pa.table({"slice": pa.array([s], pa.int64()), "strip": pa.array([strip], pa.int32()), "re": _lists([x.real]), "im": _lists([x.imag])})

    tiles = bands.select("slice", "band", *columns).mapInArrow(forward, TILES)
    return tiles.groupBy("slice", "strip").applyInArrow(lambda t: column(t), "slice long, strip int, re array<double>, im array<double>")


def sizes(strips: DataFrame, lexmax: bool = False) -> DataFrame:
    """slice, top, low, squares, n of the moduli of the coefficients; with lexmax, top is the real part of the lexicographic maximum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                c = _complex(b.column("re")[i], b.column("im")[i])
                m = np.abs(c)  # as the thresholds take it, so that the largest coefficient meets its own size
                most = c[np.lexsort((c.imag, c.real))[-1]]
                rows.append((b.column("slice")[i].as_py(), most.real, most.imag, m.max(), m.min(), (m**2).sum(), len(m)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=["slice", "a", "b", "large", "low", "squares", "n"])

    d = strips.mapInArrow(run, "slice long, a double, b double, large double, low double, squares double, n long")
    top = F.max(F.struct("a", "b"))["a"] if lexmax else F.max("large")
    return d.groupBy("slice").agg(top.alias("top"), F.max("large").alias("large"), F.min("low").alias("low"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))


def _schedule(r, niter: int, model: str, p_max: float, p_min: float | str, kind: str) -> np.ndarray:
    """The thresholds of one slice: those of the kernel on two numbers that have the same largest, least and mean square."""
    if kind == "values" and p_min == "adaptive":
        p_min = 0.01 * float(np.sqrt(r.squares / r.n)) / r.top if r.top else 0.0
    return decay(model, niter, p_max, p_min, np.array([r.large if model.startswith("inverse") else r.top, r.low]), kind)


def interpolate(
    bands: DataFrame,
    mask: DataFrame,
    shape: Shape,
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
    complex_in: bool = False,
) -> DataFrame:
    """Bands with the bins of mask 0 filled, niter and cost: projection onto convex sets, as kernels.pocs does it on a whole slice.

    mask: rows (band, mask array<double>) of 0 and 1 for one slice, joined to
    all. An iteration is two shuffles of the values and one aggregate of a row
    a slice; its result is written, so an iteration is repeated after a loss
    and none before it. Slices that have converged take no part in later ones.
    The driver keeps a cost and a list of thresholds a slice. Thresholds by
    percentiles and data-driven ones need all coefficients of a slice in order,
    and raise an error here.
    """
    if version not in VERSIONS:
        raise ValueError(f"version {version!r} is none of {', '.join(VERSIONS)}")
    if thresh_op.endswith("-percentile") or thresh_model.partition("-")[0] not in MODELS:
        raise ValueError(f"{thresh_op!r} with {thresh_model!r} needs whole slices")
    _axis(transform, 1)
    start = bands.join(mask.select("band", "mask"), "band").select("slice", "band", "mask", *[F.col(c).alias(f"{p}{c}") for p in ("x", "o", "b") for c in ("re", "im")])
    state = written(start)
    first = spectrum(state, shape, transform, lambda b, i: _complex(b.column("xre")[i], b.column("xim")[i]), ("xre", "xim"))
    taus = {}
    for r in sizes(first, compat_lexmax).toLocalIterator():
        if r.large > 0:
            s = _schedule(r, niter, thresh_model, float(p_max), p_min if p_min == "adaptive" else float(p_min), decay_kind)
            taus[r.slice] = np.sqrt(s) if sqrt_decay else s
    fields = [f.name for f in start.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.schema) + ", d double, a double, b double"
    rows_back = lambda: _axis(transform, shape.n_xl)[1]
    done: list[DataFrame] = [state.where(~F.col("slice").isin(list(taus))).select("slice", "band", F.col("ore").alias("re"), F.col("oim").alias("im"), F.lit(0).alias("niter"), F.lit(0.0).alias("cost"))]
    live, v = sorted(taus), 1.0
    kept = {"first": state}
    for k in range(1, niter + 1):
        if not live:
            break
        v1 = (1 + np.sqrt(1 + 4 * v * v)) / 2
        push = (v - 1) / v1
        v = v1

        def source(b: pa.RecordBatch, i: int, push=push) -> np.ndarray:
            x, old = (_complex(b.column(f"{p}re")[i], b.column(f"{p}im")[i]) for p in ("x", "o"))
            if version == "fast":
                return old + push * (old - _complex(b.column("bre")[i], b.column("bim")[i]))
            if version == "adaptive":
                m = _array(b.column("mask")[i])
                return alpha * x + (1 - alpha * m) * old + (1 - alpha) * (x - m * old)
            return old

        now = {s: float(taus[s][k - 1]) for s in live}

        def shrunk(t: pa.Table, now=now) -> pa.Table:
            _, back = _axis(transform, shape.n_il)
            s, strip = t.column("slice")[0].as_py(), t.column("strip")[0].as_py()
            c = _complex(t.column("re").combine_chunks()[0], t.column("im").combine_chunks()[0]).reshape(shape.columns(strip), shape.n_il)
            return _tiles(back(threshold(c, now[s], thresh_op)), s, strip, shape)

        def back_in(batches: Iterator[pa.RecordBatch], shrunk=shrunk) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield from shrunk(pa.Table.from_batches([b.slice(i, 1)])).to_batches()

        # the strips come straight from their columns' transform: threshold and way back need no shuffle between
        strips = spectrum(state.where(F.col("slice").isin(live)), shape, transform, source, tuple(fields[2:]))
        tiles = strips.mapInArrow(back_in, TILES)

        def project(left: pa.Table, right: pa.Table) -> pa.Table:
            s, band, new = _joined(left, shape)
            new = rows_back()(new).ravel()
            get = lambda p: _complex(right.column(f"{p}re").combine_chunks()[0], right.column(f"{p}im").combine_chunks()[0])
            x, old, m = get("x"), get("o"), _array(right.column("mask").combine_chunks()[0])
            if not complex_in:
                new = new.real + 0j
            new = new * (1 - alpha * m) + alpha * x * m
            p, q = np.abs(new), np.abs(old)
            d, a = ((p - q).sum(), p.sum()) if compat_cost else (((p - q) ** 2).sum(), (p**2).sum())
            out = [pa.array([s], pa.int64()), pa.array([band], pa.int32()), _lists([m])]
            for z in (x, new, old):
                out += [_lists([z.real]), _lists([z.imag])]
            return pa.Table.from_arrays([*out, *[pa.array([float(y)]) for y in (d, a, 0.0)]], names=[*fields, "d", "a", "b"])

        before = state
        pairs = tiles.groupBy("slice", "band").cogroup(before.where(F.col("slice").isin(live)).groupBy("slice", "band"))
        state = written(pairs.applyInArrow(lambda left, right: project(left, right), schema))
        if k > 1:
            kept[f"at {k - 1}"] = before
        costs = {r.slice: (r.d**2 / (r.a**2 or 1)) if compat_cost else r.d / (r.a or 1) for r in state.groupBy("slice").agg(F.sum("d").alias("d"), F.sum("a").alias("a")).toLocalIterator()}
        ended = [s for s in live if (k > 3 and costs[s] < eps) or k == niter]
        if ended:
            cost = F.element_at(F.map_from_arrays(F.array(*[F.lit(s).cast("long") for s in ended]), F.array(*[F.lit(float(costs[s])) for s in ended])), F.col("slice"))
            done.append(state.where(F.col("slice").isin(ended)).select("slice", "band", F.col("ore").alias("re"), F.col("oim").alias("im"), F.lit(k).alias("niter"), cost.alias("cost")))
            live = [s for s in live if s not in set(ended)]
        # a table that no result reads is let go
        needed = f"at {k - 1}"
        if needed in kept and not any(kept[needed]._loop_path in f for d in done for f in d.inputFiles()[:1]):
            forget(kept.pop(needed))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
