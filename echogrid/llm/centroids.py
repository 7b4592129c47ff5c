"""Lloyd's clustering with two trees: a cover tree over vectors, another over centroids.

The vectors are cut into blocks, and each block's cover tree is built once and
stored with it. Every round builds a tree over the centroids, and each block
is searched tree against tree: a node of centroids is left out for a node of
vectors when its nearest possible centroid is further than some centroid
certainly is. Leaves that are left are compared exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, stage
from .moments import finite, matrix

#: Vectors a block and its tree, vectors and centroids a leaf.
BLOCK, LEAF, CENTROID_LEAF = 1024, 16, 2
#: Components from here on could overflow a squared distance.
LIMIT = 2**26


@dataclass
class Tree:
    """Nodes by breadth; a node's vectors are order[lo:hi], its children the nodes first..last."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.first == self.last


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of the rows of x.

    The children of a node of radius r lie more than s apart, where s is the
    largest power of two below r, and each vector is with a child no further
    than s from it. A node's first child has its own centre. Radii are the
    distances to the furthest vector.
    """
    x = x.astype(float)
    sq = (x * x).sum(axis=1)
    order, nodes = np.arange(len(x)), []
    todo = [(0, 0, len(x))] if len(x) else []
    for centre, lo, hi in todo:  # grows as it goes
        own = order[lo:hi]
        at = np.sqrt(((x[own] - x[centre]) ** 2).sum(axis=1))
        radius, first = at.max(), len(todo)
        if hi - lo > leaf and radius > 0:
            apart = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            own_x, own_sq = x[own], sq[own]
            near, group, centres = at, np.zeros(len(own), int), [centre]
            while len(far := np.flatnonzero(near > apart)):
                c = own[far[0]]
                d = np.sqrt(np.maximum(own_sq + sq[c] - 2 * (own_x @ x[c]), 0))
                d[far[0]] = 0
                closer = d < near
                near, group = np.where(closer, d, near), np.where(closer, len(centres), group)
                centres.append(c)
            order[lo:hi] = own[np.argsort(group, kind="stable")]
            edges = lo + np.r_[0, np.cumsum(np.bincount(group, minlength=len(centres)))]
            todo += [(c, a, b) for c, a, b in zip(centres, edges, edges[1:], strict=False)]
        nodes.append((centre, radius, lo, hi, first, len(todo)))
    c = list(zip(*nodes, strict=True)) or [()] * 6
    ints = [np.array(c[i], np.int32) for i in (0, 2, 3, 4, 5)]
    return Tree(order.astype(np.int32), ints[0], np.array(c[1], float), *ints[1:])


def _each(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range, its number and the numbers in it."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def nearest(x: np.ndarray, xt: Tree, c: np.ndarray, ct: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of c for each row of x (ties: the smaller number) and the squared distance, exact."""
    xf, cf = x.astype(float), c.astype(float)
    v, q = np.zeros(min(1, len(x)), int), np.zeros(min(1, len(x)), int)
    leaves = []
    while len(v):
        # sorted, so that the pairs of a node of vectors stand together
        by = np.argsort(v, kind="stable")
        v, q = v[by], q[by]
        d = np.sqrt(((xf[xt.centre[v]] - cf[ct.centre[q]]) ** 2).sum(axis=1))
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        certain = np.minimum.reduceat(d + xt.radius[v], starts)
        bound = np.repeat(certain, np.diff(np.r_[starts, len(v)]))
        live = d - xt.radius[v] - ct.radius[q] <= bound * (1 + 1e-9) + 1e-6  # more than rounding can move
        v, q = v[live], q[live]
        done = xt.leaf[v] & ct.leaf[q]
        leaves.append((v[done], q[done]))
        v, q = v[~done], q[~done]
        split = ~ct.leaf[q] & (xt.leaf[v] | (ct.radius[q] >= xt.radius[v]))
        a, kids = _each(ct.first[q[split]], ct.last[q[split]])
        b, parts = _each(xt.first[v[~split]], xt.last[v[~split]])
        v, q = np.r_[v[split][a], parts], np.r_[kids, q[~split][b]]
    best, score = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    if not leaves:
        return best, score
    v, q = (np.concatenate(p) for p in zip(*leaves, strict=True))
    a, rows = _each(xt.lo[v], xt.hi[v])
    b, columns = _each(ct.lo[q[a]], ct.hi[q[a]])
    rows, columns = xt.order[rows[b]], ct.order[columns]
    d = np.concatenate([((x[rows[i : i + 8192]] - c[columns[i : i + 8192]]) ** 2).sum(axis=1) for i in range(0, len(rows), 8192)])
    by = np.lexsort((columns, d, rows))
    rows, columns, d = rows[by], columns[by], d[by]
    one = np.r_[True, rows[1:] != rows[:-1]]
    best[rows[one]], score[rows[one]] = columns[one], d[one]
    return best, score


def _blocks(df: DataFrame, dim: int) -> DataFrame:
    """ids, x and the tree's arrays: a row a block of df's (id, v)."""
    names = ["order", "centre", "radius", "lo", "hi", "first", "last"]
    schema = T.StructType([T.StructField("ids", T.ArrayType(df.schema["id"].dataType)), *[T.StructField(n, T.BinaryType()) for n in ["x", *names]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = matrix(b.column(1), dim, 0, np.int64)
                if np.abs(x).max(initial=0) >= LIMIT:
                    raise ValueError(f"a component is beyond {LIMIT}, so that squared distances would not be exact")
                x, t = x.astype(np.int32), cover_tree(x)
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([a.tobytes()], pa.binary()) for a in (x, *[getattr(t, n) for n in names])]], names=[f.name for f in schema])

    return df.select("id", "v").mapInArrow(run, schema)


def _assigned(b: pa.RecordBatch, dim: int, c: np.ndarray, ct: Tree) -> Iterator[tuple]:
    """ids, vectors, cluster and squared distance of each block of a batch."""
    for i in range(b.num_rows):
        at = {n: b.column(n)[i].as_buffer() for n in b.schema.names if n != "ids"}
        ints = {n: np.frombuffer(at[n], np.int32) for n in at if n not in ("x", "radius")}
        x = np.frombuffer(at["x"], np.int32).reshape(-1, dim).astype(np.int64)
        yield b.column("ids")[i].values, x, *nearest(x, Tree(radius=np.frombuffer(at["radius"]), **ints), c, ct)


def _update(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: a task sends counts and sums, which are added up in two steps."""
    k, dim = c.shape
    shared = blocks.sparkSession.sparkContext.broadcast((c, cover_tree(c, CENTROID_LEAF)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, ct), s = shared.value, np.zeros((k, dim + 1), np.int64)
        for b in batches:
            for _, x, cluster, _ in _assigned(b, dim, c, ct):
                np.add.at(s, cluster, np.c_[np.ones(len(x), np.int64), x])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"s": pa.array([sum(np.frombuffer(v.as_py(), np.int64) for v in t.column("s")).tobytes()], pa.binary())})

    parts = blocks.mapInArrow(run, "s binary").withColumn("key", F.spark_partition_id() % 64)
    rows = parts.groupBy("key").applyInArrow(lambda t: add(t), "s binary").collect()
    shared.destroy()
    s = sum((np.frombuffer(r.s, np.int64) for r in rows), np.zeros(k * (dim + 1), np.int64)).reshape(k, dim + 1)
    # floor division of whole numbers goes down for negative ones too
    return np.where(s[:, :1] > 0, s[:, 1:] // np.maximum(s[:, :1], 1), c)


def first_centroids(df: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows of df (id, v) with the smallest sha256 of `seed:id`; ties by the vector, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = df.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Components become floor(scale * component). Vectors that are null, of
    another length than dim, or hold null or non-finite components take no
    part; a component of LIMIT or more after scaling raises an error. Null ids
    take part, but are first centroids last. Repeated rows are vectors each.
    Fewer vectors than k: as many centroids as vectors. None: an empty result.
    Other columns are ignored.

    A round reads the blocks and broadcasts the centroids with their tree: k
    vectors. Nothing is shuffled but a task's counts and sums.
    """
    spark = df.sparkSession
    d = df.where(finite(df[vector]) & (F.size(df[vector]) == dim))
    d = d.select(d[vec_id].alias("id"), F.transform(d[vector], lambda c: F.floor(scale * c.cast("double"))).alias("v"))
    c = first_centroids(d, k, seed)
    schema = T.StructType([T.StructField(vec_id, df.schema[vec_id].dataType), *[T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()))]])
    more = T.StructType([*schema, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not len(c):
        return spark.createDataFrame([], more)
    blocks = stage(_blocks(d, dim))
    for _ in range(rounds):
        c = _update(blocks, c)
    shared = spark.sparkContext.broadcast((c, cover_tree(c, CENTROID_LEAF)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, cluster, distance in _assigned(b, dim, *shared.value):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[f.name for f in schema])

    found = stage(blocks.mapInArrow(run, schema))
    shared.destroy()
    drop_stage(blocks)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    table = spark.createDataFrame([(i, sums[i], sum(sums.values()), names[i]) for i in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(*[f.name for f in more])
