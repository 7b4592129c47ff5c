"""Embedding whitening by principal components, fitted by merging moments.

Each task computes count, local mean and centred scatter of its vectors; a tree
merges them pairwise by Chan's formula; the driver decomposes one matrix of the
dimension's square. A second pass takes the covariance of what came out and
compares it with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, stage
from .moments import Moments, finite, gathered, matrix

#: Components that are returned, at most.
COMPONENTS = 16
#: Entries that are this large can't be added up exactly.
LIMIT = 2**46


@dataclass
class Whitening:
    n: int
    total: np.ndarray  # exact, of x - offset
    offset: int
    values: np.ndarray  # eigenvalues by fall
    vectors: np.ndarray  # a column each
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows x - offset, projected on the components and divided by the standard deviations; 0 along components without any."""
        mean = np.asarray(self.total / self.n, float)
        e = np.where(self.values > 0, self.values, 1)
        return np.where(self.values > 0, (x - mean) @ self.vectors / np.sqrt(e), 0.0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each row, exact; None where a long can't hold it."""
        largest = max([self.n * int(np.abs(x).max(initial=0)), *(abs(int(s)) for s in self.total)])
        if len(self.total) * (2 * largest) ** 2 < 2**63:
            d = self.n * x - self.total.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - self.total
        return [s if s < 2**63 else None for s in (d * d).sum(axis=1).tolist()]


def _entries(column: pa.Array, dim: int, offset: int) -> np.ndarray:
    x = matrix(column, dim, offset, np.int64)
    if np.abs(x).max(initial=0) >= LIMIT:
        raise ValueError(f"an entry is beyond {LIMIT}, so that sums would not be exact")
    return x - offset


def fit(df: DataFrame, vector: str = "x", offset: int = 0, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of df, vectors of longs, each row once; None without rows.

    Components are the unit eigenvectors of the covariance (divisor n) of
    largest eigenvalue. One whose eigenvalue is zero up to rounding (fewer
    vectors than dimensions, constant dimensions) gets the value 0. A shorter
    vector is filled up with `offset`, the entry that stands for zero. An entry
    beyond LIMIT raises an error.
    """
    dim = df.agg(F.max(F.size(vector))).first()[0] or 0
    rows = df.select(vector)
    m: Moments = gathered(rows, dim, lambda b: _entries(b.column(0), dim, offset), exact=True)
    if not m.n:
        return None
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    values, vectors = values[::-1][:components], np.ascontiguousarray(vectors[:, ::-1][:, :components])
    values = np.where(values > values.max(initial=0) * dim * np.finfo(float).eps, values, 0.0)
    trace = float(np.trace(m.scatter)) / m.n
    w = Whitening(m.n, m.total, offset, values, vectors, values / trace if trace else np.zeros(len(values)))
    k = len(values)
    again: Moments = gathered(rows, k, lambda b: w.whiten(_entries(b.column(0), dim, offset)))
    kept = values > 0
    w.identity_error = float(np.abs((again.scatter / m.n - np.eye(k))[np.ix_(kept, kept)]).max(initial=0))
    return w


def transform(df: DataFrame, model: Whitening, row_id: str = "vec_id", vector: str = "x") -> DataFrame:
    """row_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row of df and component."""
    kinds = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), **dict.fromkeys(("whitened", "explained", "identity_error"), T.DoubleType())}
    schema = T.StructType([T.StructField(row_id, df.schema[row_id].dataType), *[T.StructField(c, t) for c, t in kinds.items()]])
    k, dim = len(model.values), len(model.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = _entries(b.column(1), dim, model.offset)
                each, n = np.repeat(np.arange(len(x)), k), len(x) * k
                out = [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(n, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(n, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return df.select(row_id, vector).mapInArrow(run, schema)


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = COMPONENTS) -> DataFrame:
    """Rows of transform() for every row of df whose vector is given and finite.

    An entry c becomes floor(scale * c) + offset. The fit takes each distinct
    vector once, found by an aggregation that combines copies before its
    shuffle, so a vector in a third of all rows is one row a task. Rows with
    null ids stay; repeated rows are answered each; rows with null vectors or
    with null or non-finite components give none. Vectors of different lengths
    are taken as if filled up with zeros; an empty vector is one of zeros
    beside longer ones. No rows, or empty vectors only: no result. Other
    columns are ignored.
    """
    spark = df.sparkSession
    d = df.where(finite(df[vector]))
    d = d.select(d[vec_id].alias(vec_id), F.transform(d[vector], lambda c: F.floor(scale * c.cast("double")) + offset).alias("x"))
    distinct = stage(d.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    model = fit(distinct, "x", offset, components)
    drop_stage(distinct)
    if model is None:
        schema = transform(d, Whitening(1, np.zeros(0, object), 0, np.zeros(0), np.zeros((0, 0)), np.zeros(0)), vec_id).schema
        return spark.createDataFrame([], schema)
    return transform(d, model, vec_id)
