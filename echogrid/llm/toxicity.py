"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is the bag of its character n-grams, word boundaries included, hashed to
a fixed number of features; the value of one is the root of its share of the
text's n-grams. Every feature is scaled by the logarithm of the ratio in which
toxic and other training texts hold it, and a logistic regression is fitted on
the scaled features. Ratios come from all training rows. No feature is left
out; those whose ratios have the same sign and about the same significance
share a weight, so that the regression itself learns how little a chance ratio
says, and how much one that isn't. A training row is scaled by the ratios of
the other rows, since its own label is in the counts. The regression is fitted
on the driver, on at most `max_rows` training rows of 2 * (len(EDGES) + 1)
numbers, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Lengths of n-grams, and the number of hashed features as a power of two.
NGRAMS = (4, 5, 6, 7)
BITS = 21
SLICES, FAN = 16, 64
#: Bounds, in standard errors, between the classes of significance whose features share a weight.
EDGES = np.array([0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5, 6, 8, 12])
#: Penalty on the squares of weights, and the root mean square of a class's sums as the regression sees them.
L2, SIZE = 1.0, 3.0
#: The regression's training rows: the first in the order of a hash of their id.
MAX_ROWS = 8_000
#: A table of labels of up to so many rows (some 40 MB) is broadcast.
BROADCAST_ROWS = 2_000_000


def hashed(text: str | None, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS) -> np.ndarray:
    """A hash for each n-gram of the lower-cased text, repeats included; any white space counts as one blank."""
    c = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(ngrams) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        if n in ngrams:
            x = h ^ (h >> np.uint64(29))
            out.append(((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def values(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, and the root of their share per mille; short texts count as 300 n-grams."""
    u, n = np.unique(h, return_counts=True)
    return u, np.sqrt(n * (1000.0 / max(len(h), 300))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each feature, its scale included
    intercept: float

    def score(self, text: str | None) -> float:
        u, x = values(hashed(text))
        z = self.intercept + float(self.weights[u] @ x)
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def counts(labelled: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows with label 0 and 1, their rows that hold each feature): sums over all rows of (id, text, label).

    A task adds its rows up in arrays of a fixed size, which are added up slice
    by slice, FAN at a time and FAN of those sums at a time; the last group has
    a row for FAN * FAN tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = np.zeros(2, np.int64), np.zeros((2, 1 << bits), np.int32)
        for b in batches:
            for t, y in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                n[y] += 1
                held[y, np.unique(hashed(t.as_py()))] += 1
        if n.any():
            parts = held.reshape(2, SLICES, -1)
            part = pa.array([TaskContext.get().partitionId() // FAN] * SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES)), part, pa.array([n.tobytes()] * SLICES), pa.array([parts[:, i].tobytes() for i in range(SLICES)])], names=["slice", "part", "n", "held"])

    def add(kind: type):
        def run(t: pa.Table) -> pa.Table:
            total = lambda c, d: sum(np.frombuffer(x.as_buffer(), d).astype(np.int64) for x in t.column(c)).tobytes()
            return pa.table({"part": t.column("part")[:1], "slice": t.column("slice")[:1], "n": [total("n", np.int64)], "held": [total("held", kind)]})

        return run

    schema = "slice long, n binary, held binary"
    parts = labelled.select("text", "label").mapInArrow(run, "slice long, part long, n binary, held binary")
    some = parts.groupBy("slice", "part").applyInArrow(add(np.int32), f"part long, {schema}")
    more = some.groupBy("slice", F.floor(F.col("part") / FAN)).applyInArrow(add(np.int64), f"part long, {schema}")
    rows = more.groupBy("slice").applyInArrow(add(np.int64), f"part long, {schema}").orderBy("slice").collect()
    if not rows:
        return np.zeros(2, np.int64), np.zeros((2, 1 << bits), np.int64)
    held = np.concatenate([np.frombuffer(r["held"], np.int64).reshape(2, -1) for r in rows], axis=1)
    return np.frombuffer(rows[0]["n"], np.int64), held


def ratios(n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the ratio of the smoothed rates, and how many standard errors it is from zero."""
    p = (held + 0.5) / (n[:, None] + 1.0)
    r = np.log(p[1] / p[0])
    return r.astype(np.float32), (np.abs(r) / np.sqrt(((1 - p) / (held + 0.5)).sum(axis=0))).astype(np.float32)


def classes(r: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The class of each feature by the sign and the significance of its ratio."""
    return np.searchsorted(EDGES, z, "right") + (len(EDGES) + 1) * (r > 0)


@dataclass(frozen=True)
class Scales:
    """Counts of all training rows (see counts())."""

    n: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(n: np.ndarray, held: np.ndarray) -> Scales:
        return Scales(n, held.astype(np.int32) if held.max(initial=0) < 1 << 31 else held)

    def sums(self, text: str | None, label: int | None) -> np.ndarray:
        """The sums of a text's scaled features by class; a training row's own label is taken out of the counts."""
        u, x = values(hashed(text))
        less = np.array([label == 0, label == 1], np.int64)
        r, z = ratios(self.n - less, self.held[:, u] - less[:, None])
        return np.bincount(classes(r, z), x * r, 2 * (len(EDGES) + 1))


def regression(x: np.ndarray, labels: np.ndarray, l2: float = L2, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and intercept: Newton's method on the mean log loss and the penalty on the weights."""
    m, k = x.shape
    a, w = np.c_[x, np.ones(m)], np.zeros(k + 1)
    ridge = np.r_[np.full(k, l2 / m), 1e-12]

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - labels @ z) / m + float(ridge @ (w * w)) / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -700, 700)))
        g = a.T @ (p - labels) / m + ridge * w
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a / m + np.diag(ridge + 1e-12), g)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, done, now = w - size * step, now - new < 1e-13, min(new, now)
        if done:
            break
    return w[:k], float(w[k])


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """From rows of (id, text, label 0 or 1). Without rows of both labels the score is one constant.

    Rows that repeat count in the ratios as often as they occur, in the
    regression once (of an id with several texts, one). Which rows that takes
    is decided on hashes of id and label; only then are their texts read. Texts
    of any length are taken whole.
    """
    n, held = counts(labelled)
    if not n.all():
        return Model(np.zeros(held.shape[1], np.float32), float(np.log((n[1] + 1) / (n[0] + 1))))
    scales = Scales.of(n, held)
    del held
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(scales)  # 17 or 34 MB, whatever the input
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("label").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column("label").to_pylist()
            c = [shared.value.sums(t.as_py(), y) for t, y in zip(b.column("text"), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label").cast(pa.int32()), pa.array([v.tolist() for v in c], pa.list_(pa.float64()))], names=["key", "label", "c"])

    keyed = labelled.select(key.alias("key"), "text", "label")
    chosen = keyed.select("key").distinct().orderBy("key").limit(max_rows)
    rows = keyed.join(F.broadcast(chosen), "key").mapInArrow(run, "key string, label int, c array<double>")
    rows = rows.groupBy("key").agg(F.min(F.struct("c", "label")).alias("row")).orderBy("key").select("row.*").collect()
    shared.destroy()
    c = np.array([r["c"] for r in rows])
    unit = SIZE / np.maximum(np.sqrt((c**2).mean(axis=0)), 1e-3)
    w, b = regression(c * unit, np.array([r["label"] for r in rows], float))
    weights = np.empty(scales.held.shape[1], np.float32)
    for part in np.array_split(np.arange(len(weights)), SLICES):
        r, z = ratios(n, scales.held[:, part])
        weights[part] = r * (w * unit)[classes(r, z)]
    return Model(weights, b)


def score(df: DataFrame, model: Model, text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `more`, then score, for every row of df: whole texts, empty and null ones too.

    A text's n-grams are in memory at once, some 50 bytes a character. Rows
    that repeat get equal scores. An input column called score is replaced.
    """
    more = more or {c: df[c] for c in df.columns if c != "score"}
    d = df.select(df[text].alias("__text"), *[v.alias(k) for k, v in more.items()])
    shared = df.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = pa.array([m.score(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], scores], names=[*b.schema.names[1:], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(run, f"{schema}, score double" if schema else "score double")


def train_rows(df: DataFrame, labels: DataFrame, chosen: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, label) of the documents that have a label and are chosen.

    `chosen` is an expression on the column `id`. Null labels, others than 0
    and 1, and null ids don't count; a document with several labels counts once
    for each, as do documents that repeat. Null texts are empty.
    """
    y = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & chosen)
    y = stage(y)
    d = df.select(df[doc_id].alias("id"), df[text].alias("text"))
    return d.join(F.broadcast(y) if y.count() <= BROADCAST_ROWS else y, "id")
