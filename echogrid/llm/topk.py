"""Exact top-k search by inner product, norm-sorted.

Vectors are processed by descending length. All are rotated by the right
singular vectors of the corpus, which puts most of an inner product into the
first coordinates: their partial sum, plus the product of the two residual
lengths (Cauchy-Schwarz), bounds the whole. A candidate is computed exactly
only if that bound reaches the score that the query's k-th best has so far; a
block whose longest vector can't reach it is left out as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage

K = 5
#: Vectors a block, queries a broadcast (some 32 MB at 64 dimensions), vectors from which first bounds come.
BLOCK, QUERIES, SEEDS = 2048, 65_536, 2048
#: Whole components below this have exact scores up to 128 dimensions.
EXACT = 2**23
#: Coordinates of the partial sum, as a share of all.
HEAD = 0.25


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: id given, vector neither null nor with null or non-finite components."""
    d = df.select(df[vec_id].cast("long").alias("id"), F.transform(df[vector], lambda x: x.cast("double")).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return d.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: F.coalesce(bad(x), F.lit(True))))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in [*lengths, 0]])] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors, by falling singular value, from the sum of x xT over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([g.tobytes()])], names=["key", "g"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"key": t.column("key")[:1], "g": [sum(np.frombuffer(x.as_py()) for x in t.column("g")).tobytes()]})

    parts = vectors.select("v").mapInArrow(run, "key long, g binary").withColumn("key", F.spark_partition_id().cast("long") % 64)
    rows = parts.groupBy("key").applyInArrow(add, "key long, g binary").collect()
    g = sum((np.frombuffer(r["g"]) for r in rows), np.zeros(dim * dim)).reshape(dim, dim)
    return np.linalg.eigh(g)[1][:, ::-1].copy()


class Searcher:
    """The best k of what it has seen, for a set of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotate: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.head = max(1, round(HEAD * q.shape[1])) if q.shape[1] else 0
        self.rotate, r = rotate, q @ rotate
        self.qh, self.rest = r[:, : self.head], np.sqrt((r[:, self.head :] ** 2).sum(axis=1))
        self.norm = np.sqrt((q**2).sum(axis=1))
        self.bound = np.full(len(ids), -np.inf)  # of the k-th best
        self.best = np.zeros((0, 3))  # query's place, score, id
        self.best_id = np.zeros(0, np.int64)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A block by falling length."""
        norm = np.sqrt((x**2).sum(axis=1))
        slack = 1e-9 * (1 + self.norm * norm.max(initial=0))  # more than rounding can take from a bound
        live = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.bound)
        r = x @ self.rotate
        xh, rest = r[:, : self.head], np.sqrt((r[:, self.head :] ** 2).sum(axis=1))
        for at in range(0, len(live), 512):
            i = live[at : at + 512]
            upper = self.qh[i] @ xh.T
            upper += self.rest[i, None] * rest
            a, b = np.nonzero(upper + slack[i, None] >= self.bound[i, None])
            a = i[a]
            own = self.ids[a] != ids[b]
            self._keep(a[own], b[own], ids, x)

    def _keep(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(a):
            return
        if len(a) > 0.2 * len(np.unique(a)) * len(x):  # little was pruned: a product of matrices is cheaper
            u, p = np.unique(a, return_inverse=True)
            s = (self.q[u] @ x.T)[p, b]
        else:
            s = np.concatenate([np.einsum("ij,ij->i", self.q[a[j : j + 65536]], x[b[j : j + 65536]]) for j in range(0, len(a), 65536)])
        fit = s >= self.bound[a]
        a, s, new = a[fit], s[fit], ids[b[fit]]
        touched = np.isin(self.best[:, 0], a)
        place = np.concatenate([self.best[touched, 0], a])
        score, vec = np.concatenate([self.best[touched, 1], s]), np.concatenate([self.best_id[touched], new])
        order = np.lexsort((vec, -score, place))
        place, score, vec = place[order], score[order], vec[order]
        first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
        rank = np.arange(len(place)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(place)]))
        full = rank == self.k - 1
        self.bound[place[full].astype(int)] = score[full]
        top = rank < self.k
        self.best = np.concatenate([self.best[~touched], np.stack([place[top], score[top], np.zeros(top.sum())], axis=1)])
        self.best_id = np.concatenate([self.best_id[~touched], vec[top]])


def search(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score double: the k largest inner products of each query.

    is_query is an expression on the column `id`. A query's candidates are all
    rows with another id; ties go to the smaller id. Null vectors, vectors with
    null or non-finite components and rows without id take no part. Vectors of
    different lengths are compared as if filled with zeros. Scores are sums of
    doubles: whole components below EXACT have exact ones, and the query over
    whole components refuses others. Repeated rows are
    candidates each; a query that repeats in all is answered once. Fewer than k
    candidates give as many rows. Other columns are ignored.

    The queries are broadcast in groups of about QUERIES, each of which is one
    pass over the blocks: a task sends at most k rows a query, the group's
    results are written, and its broadcast is released before the next group.
    """
    spark = df.sparkSession
    v = stage(valid(df, vec_id, vector).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    out = "query_id long, place long, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotate = rotation(v, dim)
    # the id is in the range, so that equal lengths are split too
    order = [F.col("norm").desc(), F.col("id")]
    ordered = stage(v.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order))
    seeds = v.orderBy(*order).limit(SEEDS).select("id", "v").toArrow()
    seed_ids, seed_x = seeds.column("id").to_numpy(), _matrix(seeds.column("v").combine_chunks(), dim)
    queries = v.where(is_query).select("id", "v").dropDuplicates()
    queries = stage(queries.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-queries.count() // QUERIES) * 2 - 1)))))
    found = None
    for (g,) in sorted(queries.select("g").distinct().collect()):
        t = queries.where(F.col("g") == g).orderBy("id", "v").select("id", "v").toArrow()
        s = Searcher(t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), dim), rotate, k)
        s.see(seed_ids, seed_x)
        s.best, s.best_id = s.best[:0], s.best_id[:0]  # only the bounds stay: each seed comes again in its block
        shared = spark.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import copy

            s = copy.copy(shared.value)
            s.bound = s.bound.copy()
            for b in batches:
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                for at in range(0, len(ids), BLOCK):
                    s.see(ids[at : at + BLOCK], x[at : at + BLOCK])
            place = s.best[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[place]), pa.array(place), pa.array(s.best_id), pa.array(s.best[:, 1])], names=["query_id", "place", "vec_id", "score"])

        hits = ordered.select("id", "v").mapInArrow(run, out)
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id"))
        best = stage(hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        shared.destroy()
        found = best if found is None else found.unionByName(best)
    for used in (queries, ordered, v):
        drop_stage(used)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
