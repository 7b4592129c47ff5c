"""Counts, sums and centred scatter of vectors, merged by Chan's pairwise formula."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for arrays that are neither null nor hold null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(F.transform(vector, lambda x: x.cast("double")), lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(True))


def matrix(column: pa.Array, dim: int, fill: float = 0, dtype=None) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    dtype = dtype or flat.dtype
    if (lengths == dim).all():
        return flat.reshape(-1, dim).astype(dtype, copy=False)
    out = np.full((len(lengths), dim), fill, dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


@dataclass
class Moments:
    """n vectors, their sum (exact: whole numbers in an object array; or doubles), and their scatter about the mean."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, exact: bool = False) -> Moments:
        """The moments of the rows of x, centred on their own mean before anything is multiplied."""
        total = x.sum(axis=0)
        if not len(x):
            return cls(0, total.astype(object) if exact else total, np.zeros((x.shape[1],) * 2))
        c = x - total / len(x)
        return cls(len(x), total.astype(object) if exact else total, c.T @ c)

    @property
    def mean(self) -> np.ndarray:
        return np.asarray(self.total / max(self.n, 1), float)

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        # both means are about the same large number; their difference comes from sums about zero
        d = np.asarray((other.total * self.n - self.total * other.n) / (self.n * other.n), float)
        n = self.n + other.n
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(d, d) * (self.n / n * other.n))


def gathered(df: DataFrame, dim: int, rows: Callable[[pa.RecordBatch], np.ndarray], exact: bool = False) -> Moments:
    """The moments of all rows of df: one of each task, merged in a tree; the driver sees the last of them.

    `rows` makes a matrix of a batch; exact: of whole numbers below 2^46.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        m = Moments.of(np.zeros((0, dim)), exact)
        for b in batches:
            m = m + Moments.of(rows(b), exact)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], names=["m"])

    def load(row) -> Moments:
        import pickle

        return pickle.loads(bytes(row.m))

    parts = df.mapInArrow(run, "m binary").rdd.map(load)
    return parts.treeReduce(Moments.__add__, depth=3) if parts.getNumPartitions() else Moments.of(np.zeros((0, dim)), exact)
