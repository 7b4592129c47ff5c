"""The three layouts of survey data, and what turns one into another.

L1, trace rows: (line, tracl, ..., samples array<double>), one row a trace.
L2, sample rows: (line, tracl, ..., i, amp), one row a sample.
L3, slice rows: (slice, n_il, n_xl, grid array<double>), one row a time or
frequency slice, with the inline/crossline grid in row-major order.

L1 and L2 need no shuffle between them in one direction. L3 collects one value
for each bin of a slice; its size is the grid's, not the survey's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_samples(traces: DataFrame, samples: str = "samples") -> DataFrame:
    """L1 to L2: sample number i from 0, amplitude amp."""
    rest = [c for c in traces.columns if c != samples]
    return traces.select(*rest, F.posexplode(samples).alias("i", "amp"))


def to_traces(samples: DataFrame, *keys: str, value: str = "amp", name: str = "samples") -> DataFrame:
    """L2 to L1: one row for each value of the keys, samples in the order of i."""
    return samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value))), lambda s: s[value]).alias(name))


def per_slice(cube: DataFrame, n_il: int, n_xl: int, made: Callable[[int, list[np.ndarray]], pa.Table], schema: str, value: str = "amp", imag: str | None = None) -> DataFrame:
    """made(slice, grids) for each slice of the rows (il, xl, i, value[, imag]), il and xl from 1.

    Grids are row-major; bins without a row are zero, of repeated ones the least
    value counts. One shuffle; a task holds one slice, where slices as rows
    would come to it in batches.
    """
    values = [value, *([imag] if imag else [])]
    at = ((F.col("il") - 1).cast("long") * n_xl + F.col("xl") - 1).alias("k")

    def build(t: pa.Table) -> pa.Table:
        k, v = t.column("k").to_numpy(), [t.column(f"v{j}").to_numpy() for j in range(len(values))]
        order = np.lexsort((*reversed(v), k))
        k, first = k[order], np.r_[True, np.diff(k[order]) != 0]
        grids = []
        for x in v:
            grid = np.zeros(n_il * n_xl)
            grid[k[first]] = x[order][first]
            grids.append(grid)
        return made(t.column("slice")[0].as_py(), grids)

    d = cube.select(F.col("i").cast("long").alias("slice"), at, *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(values)])
    return d.groupBy("slice").applyInArrow(build, schema)


def lists(grid: np.ndarray) -> pa.Array:
    """A column of one row, which holds the array; nothing is copied."""
    flat = np.ascontiguousarray(np.ravel(grid), float)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))


def to_slices(cube: DataFrame, n_il: int, n_xl: int, value: str = "amp", imag: str | None = None) -> DataFrame:
    """Rows (il, xl, i, value[, imag]), il and xl from 1, to L3; bins without a row are zero, of repeated ones the least value counts.

    One shuffle; a slice is put together in an array of the grid's size.
    """
    schema = "slice long, n_il int, n_xl int, grid array<double>" + ", imag array<double>" * bool(imag)

    def row(number: int, grids: list[np.ndarray]) -> pa.Table:
        names = ["slice", "n_il", "n_xl", "grid", "imag"][: 3 + len(grids)]
        return pa.Table.from_arrays([pa.array([number], pa.int64()), pa.array([n_il], pa.int32()), pa.array([n_xl], pa.int32()), *map(lists, grids)], names=names)

    return per_slice(cube, n_il, n_xl, row, schema, value, imag)


def from_slices(slices: DataFrame, grid: str = "grid", value: str = "amp", more: Sequence[str] = ()) -> DataFrame:
    """L3 to rows (slice, il, xl, value), and more columns of the slice."""
    e = slices.select("slice", "n_xl", *more, F.posexplode(grid).alias("k", value))
    return e.select("slice", (F.floor(F.col("k") / F.col("n_xl")) + 1).cast("int").alias("il"), (F.col("k") % F.col("n_xl") + 1).cast("int").alias("xl"), value, *more)


def even(samples: Column | str) -> Column:
    """Transforms take an even number of samples: an odd one drops its last."""
    s = F.col(samples) if isinstance(samples, str) else samples
    return F.slice(s, 1, F.size(s) - F.size(s) % 2)


def batches(slices: DataFrame, size: int, index: str = "slice") -> DataFrame:
    """Adds batch = floor(index / size), the folder that a slice is written to."""
    return slices.withColumn("batch", F.floor(F.col(index) / size).cast("int"))


def batch_name(prefix: str, start: Column, end: Column) -> Column:
    """prefix_start_end.nc with both bounds as %06.3f."""
    return F.format_string(prefix + "_%06.3f_%06.3f.nc", start.cast("double"), end.cast("double"))


def join_complex(re: Column, im: Column) -> Column:
    """Two arrays to one array<struct<re,im>>."""
    return F.zip_with(re, im, lambda a, b: F.struct(a.alias("re"), b.alias("im")))
