"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS bits of each other have a common variant within
half the radius of both. So every distinct fingerprint emits its ball of half
the radius (for 64 bits and a radius of 4: 2081 variants), and those that meet
on a variant are near each other. All that meet on one variant are within the
radius of one another, so each is linked to the smallest of them, and a group
of any size costs as many links as it has members.

Variants are sharded by their first bits (a shard that many near fingerprints
share, by more of them). A fingerprint goes once to each shard
that some of its variants belong to (those within the same number of flips of
its own first bits), and the shard forms the rest of the ball itself; so a
fingerprint moves some dozens of times and not 2081 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, drop_stage, restored, stage

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints (16 bytes each) from which a shard is cut by the next bits before the shuffle; by twice as many from a hundred times as many on.
HOT_ROWS, HOT_BITS = 1_000_000, 8
#: A table of components of up to so many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
#: Variants that one shard holds on average, and that a task forms at once (some 100 MB); a shard with more is cut by further bits.
SHARD_VARIANTS, AT_ONCE = 3_000_000, 6_000_000
U = np.uint64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; unsigned."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower() changes A-Z only, split() cuts at \x20\x09-\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = np.r_[0, ends[:-1]]
        m = len(w) - words + 1
        h = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def masks(bits: int, flips: int) -> list[int]:
    """All masks of the lowest `bits` bits with at most `flips` of them set."""
    return [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)]


def fingerprints(df: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """doc_id, fp: one row for each row of df; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    return df.select(df[doc_id], df[text]).mapInArrow(run, schema)


def _stars(v: np.ndarray, o: np.ndarray, radius: int) -> np.ndarray:
    """(owner, least owner) pairs of the variants v that several owners o share; each pair is verified."""
    by_value = np.sort(v)
    twice = np.unique(by_value[1:][by_value[1:] == by_value[:-1]])
    if not len(twice):
        return np.zeros((0, 2), U)
    place = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = twice[place] == v
    place, o = place[hit], o[hit]
    least = np.full(len(twice), np.iinfo(U).max, U)
    np.minimum.at(least, place, o)
    near = (o != least[place]) & (np.bitwise_count(o ^ least[place]) <= radius)
    return np.unique(np.stack([o[near], least[place][near]], axis=1), axis=0)


def _met(v: np.ndarray, o: np.ndarray, left: np.ndarray, free: int, radius: int) -> Iterator[np.ndarray]:
    """Stars among the variants of v that differ from it in at most `left` of the lowest `free` bits."""
    if len(v) < 2:
        return
    sizes = np.array([sum(comb(free, k) for k in range(n + 1)) for n in range(int(left.max()) + 1)])
    if sizes[left].sum() > AT_ONCE and free > 4:
        cut = U(free - 4)
        for value in range(16):
            flipped = ((v >> cut) & U(15)) ^ U(value)
            rest = left - np.bitwise_count(flipped).astype(left.dtype)
            ok = rest >= 0
            yield from _met(v[ok] ^ (flipped[ok] << cut), o[ok], rest[ok], free - 4, radius)
        return
    vs, os = [], []
    for n in np.unique(left):
        m = np.array(masks(free, int(n)), U)
        vs.append((v[left == n][:, None] ^ m).ravel())
        os.append(np.repeat(o[left == n], len(m)))
    yield _stars(np.concatenate(vs), np.concatenate(os), radius)


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: distinct fingerprints of the column fp within the radius, a star for each variant on which some of the n meet."""
    half = (radius + 1) // 2  # for an odd radius the larger half
    ball = sum(comb(64, k) for k in range(half + 1))
    p = min(32, max(0, ceil(log2(max(1.0, n * ball / SHARD_VARIANTS)))))
    own = F.shiftrightunsigned("fp", 64 - p) if p else F.lit(0).cast("long")
    near = F.transform(F.array(*[F.lit(m).cast("long") for m in masks(p, half)]), lambda m: own.bitwiseXOR(m))
    sent = nodes.select("fp", F.explode(near).alias("shard"))
    hot = sent.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = stage(hot.select("shard", F.when(F.col("n") > 100 * HOT_ROWS, 2 * HOT_BITS).otherwise(HOT_BITS).alias("q")))
    flips = {q: [np.array(masks(q, k), U) for k in range(half + 1)] for q in (HOT_BITS, 2 * HOT_BITS)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint of a hot shard goes to the values of the next q bits that its variants there have."""
        for b in batches:
            o, shard, qs = (b.column(k).to_numpy() for k in range(3))
            o = o.view(U)
            left = half - np.bitwise_count((o >> U(64 - p)) ^ shard.view(U) if p else np.zeros(len(o), U)).astype(np.int64)
            for q in np.unique(qs).tolist():
                for k in range(half + 1):
                    i = np.flatnonzero((qs == q) & (left == k))
                    m = flips[q][k]
                    part = ((o[i] >> U(64 - p - q)) & U((1 << q) - 1))[:, None] ^ m
                    at = np.repeat(i, len(m))
                    yield pa.RecordBatch.from_arrays([pa.array(o[at].view(np.int64)), pa.array(shard[at]), pa.array(np.full(len(at), q, np.int32)), pa.array(part.ravel().astype(np.int64))], names=["fp", "shard", "q", "part"])

    cold = sent.join(hot, "shard", "left_anti").select("fp", "shard", F.lit(0).alias("q"), F.lit(0).cast("long").alias("part"))
    sent = cold.union(sent.join(hot, "shard").select("fp", "shard", "q").mapInArrow(cut, "fp long, shard long, q int, part long")) if hot.count() else cold

    def meet(t: pa.Table) -> pa.Table:
        shard, q, part = U(t.column("shard")[0].as_py()), t.column("q")[0].as_py(), U(t.column("part")[0].as_py())
        o, free = t.column("fp").to_numpy().view(U), 64 - p - q
        flipped = ((o >> U(free)) ^ ((shard << U(q)) | part)) if p + q else np.zeros(len(o), U)
        v = o ^ (flipped << U(free)) if p + q else o
        pairs = np.concatenate([np.zeros((0, 2), U), *_met(v, o, half - np.bitwise_count(flipped).astype(np.int64), free, radius)])
        a, b = (pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return sent.groupBy("shard", "q", "part").applyInArrow(meet, "a long, b long").distinct()


def near_keys(rows: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): keys of rows (key, text) that connect all texts whose fingerprints are within the radius; written.

    Texts of one fingerprint are linked to the least key among them, and those
    stand for the fingerprint in its links.
    """
    docs = stage(fingerprints(rows, "key", "text", words).distinct())
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    fps = nodes.select("fp").repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    met = stage(links(fps, nodes.count(), radius))
    x, y = (nodes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_key")) for c in "ab")
    across = met.join(x, "a").join(y, "b").select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))
    same = docs.join(nodes, "fp").where(F.col("doc_id") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    out = stage(same.union(across).distinct())
    for used in (met, nodes, docs):
        drop_stage(used)
    return out


def components(edges: DataFrame) -> DataFrame:
    """v, p: each end of an edge with the smallest end that it can reach.

    Rounds of: take the least label among the neighbours, give it to the old
    label as well, then follow labels one step. A path of n edges takes about
    log n rounds; each is written to the shared folder.
    """
    e = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    p = stage(e.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")))
    while True:
        # the label of a hub goes to all its edges: a broadcast where the labels are few, else a join that Spark splits
        near = e.join(p, e.b == p.v).groupBy("a").agg(F.min("p").alias("m"))
        low = stage(p.join(near, p.v == near.a).select("v", "p", F.least("p", "m").alias("m")))
        hooked = low.select("v", "m").union(low.select(F.col("p"), F.col("m"))).groupBy("v").agg(F.min("m").alias("m"))
        hooked = stage(hooked)
        up = hooked.select(F.col("v").alias("u"), F.col("m").alias("um"))
        new = hooked.join(up, hooked.m == up.u).select("v", F.least("m", "um").alias("p"))
        new = stage(new.join(p.select(F.col("v").alias("w"), F.col("p").alias("old")), F.col("v") == F.col("w")).select("v", "p", (F.col("p") != F.col("old")).alias("changed")))
        for used in (low, hooked, p):
            drop_stage(used)
        p = new.select("v", "p")
        if not new.where("changed").limit(1).count():
            drop_stage(e)
            return p


def named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """key, component_id of nodes (key, first) by the labels (v, p) of those that are linked; the others are alone."""
    linked = stage(labels.join(nodes, F.col("v") == F.col("key")).select("key", "p", "first"))
    least = stage(linked.groupBy("p").agg(F.min("first").alias("component_id")))
    if least.count() <= BROADCAST_ROWS:  # a component of any size costs one row; beyond that, a join that Spark splits
        least = F.broadcast(least)
    known = linked.join(least, "p").select(F.col("key").alias("k"), "component_id")
    return nodes.join(known, F.col("key") == F.col("k"), "left").select("key", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of df.

    component_id is the smallest doc_id that can be reached over links of at
    most `radius` differing bits, itself included. Texts without words, null
    ones too, have fingerprint 0, which is linked like any other. Rows without
    doc_id take part in links; their component_id is null if nothing reached
    has an id. Repeated rows are one node. Other columns are ignored. Equal
    fingerprints are aggregated before anything else, so a group of copies of
    any size is one node; only the last join meets its rows, where they are or
    in a skewed join that Spark splits. A text's shingles are in memory at once,
    some 100 bytes a word.
    """
    docs = stage(fingerprints(df, doc_id, text, words))
    nodes = stage(docs.groupBy(F.col("fp").alias("key")).agg(F.min("doc_id").alias("first")))
    fps = nodes.select(F.col("key").alias("fp")).repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n = nodes.count()
    found = stage(links(fps, n, radius))
    labels = components(found)
    drop_stage(found)
    out = named(nodes, labels).withColumnRenamed("key", "fp")
    # copies of any number meet their name where they are; beyond the bound, in a join that Spark splits
    return docs.join(F.broadcast(out) if n <= BROADCAST_ROWS else out, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept_rows(df: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of df, one for each group: that with the smallest doc_id, in df's columns.

    Rows that repeat the id kept are one row, the least by their columns' hash.
    Rows without doc_id all stay.
    """
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    rows = carried(df, id=df[doc_id])
    kept = rows.where(F.col("id").isNotNull()).join(keep, "id")
    one = kept.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return restored(one.select("row").union(rows.where(F.col("id").isNull()).select("row")))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of df, one for each group of near_duplicates(), as kept_rows() keeps them."""
    return kept_rows(df, near_duplicates(df, doc_id, text, words, radius), doc_id)
