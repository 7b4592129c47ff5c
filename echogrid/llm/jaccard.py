"""Near-dedup by SimHash, each link verified by the exact Jaccard similarity of word shingles, completed by a prefix join.

Links of fingerprints (see simhash) are candidates like those of the join below.

All shingles have one order. Two sets that share enough of their shingles share
one among the first of each in that order (a fifth of them and one, for a
similarity of 0.8), so only those first shingles meet: no pair is missed,
whatever the order is. Shingles that are frequent in the corpus, counted over
all texts, come last in it, so that few texts meet on one shingle.

How many they share there bounds the similarity, so few pairs that aren't near
are compared. Of those that meet on a shingle each is first compared with one
of them, and only pairs that no verified links connect after that are compared
as well, so a large group of near copies costs about as many comparisons as it
has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, drop_stage, drop_stages, n_staged, packed, planes, release, stage, unpacked, unplanes
from .lm_scoring import _C1, mixed, tokens
from .simhash import components, kept_rows, named, near_keys

#: Similarity from which two texts are near: NUMERATOR / DENOMINATOR.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: A shingle that so many texts hold is frequent; frequent ones that are broadcast (12 bytes each). Both bear on the order only.
COMMON, MAX_COMMON = 16, 8_000_000
#: Pairs of different components that meet on a shingle, for an entry, from which another pass over heads is made.
MANY_PAIRS = 16
#: Texts on a shingle from which pairs are counted in blocks, and texts a block.
BIG, BLOCK = 64, 1024
#: Heads that a text is compared with in such a pass.
HEADS = 16
#: Prefix entries that one shard holds on average, and that a task holds before it sends them; characters of text for one entry.
SHARD_ENTRIES, AT_ONCE, CHARS_AN_ENTRY = 500_000, 500_000, 30
#: Shingles that a shard counts on average, and that a task counts before it sends them; characters of text for one.
SHARD_SHINGLES, COUNT_ONCE, CHARS_A_SHINGLE = 2_000_000, 1_000_000, 6
#: A table of keys of up to so many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
U = np.uint64
#: own: how many of the prefix are not frequent; the fewer, the more other texts are like this one.
ENTRY = np.dtype([("shingle", "<u8"), ("key", "<i8"), ("size", "<i8"), ("own", "<i8")])


def shingle_sets(texts: pa.StringArray, words: int = WORDS) -> Iterator[np.ndarray]:
    """64-bit hashes of the distinct word shingles of each text, sorted; a text of fewer words is one shingle, one without words has none."""
    for _, n, h in tokens(texts):
        ends = np.cumsum(n) - 1  # of the words; behind them stands the token that ends a text
        x = h[: max(0, len(h) - words + 1)].copy()
        for j in range(1, words):
            x = mixed(x * _C1 + h[j : j + len(x)])
        for a, b in zip((ends - n + 1).tolist(), ends.tolist(), strict=True):
            if b - a >= words:
                yield np.unique(x[a : b - words + 1])
            else:
                y = h[a : min(a + 1, b)].copy()
                for j in range(a + 1, b):
                    y = mixed(y * _C1 + h[j : j + 1])
                yield y


def _entries(shingle: pa.Buffer, key: pa.Buffer, size: pa.Buffer, own: pa.Buffer) -> np.ndarray:
    out = np.empty(key.size // 8, ENTRY)
    out["shingle"], out["key"], out["size"], out["own"] = unpacked(shingle), np.frombuffer(key, "<i8"), unplanes(size).view(np.int64), unplanes(own).view(np.int64)
    return out


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of s in the order of all, and how frequent each is (0: not); those not frequent by value, then the others by count and value."""
    n = len(s) - -(-len(s) * NUMERATOR // DENOMINATOR) + 1 if len(s) else 0
    if not len(common):
        return s[:n], np.zeros(n, counts.dtype)
    known = s >> U(shift)
    place = np.minimum(np.searchsorted(common, known), len(common) - 1)
    often = np.where(common[place] == known, counts[place], counts.dtype.type(0))
    first = np.flatnonzero(often == 0)[:n]
    if len(first) < n:
        first = np.lexsort((s, often))[:n]
    return s[first], often[first]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], pa.StringArray]]:
    """Keys and texts of (key, text), without those that the task has met before."""
    seen: set[int] = set()
    for b in batches:
        keys = b.column(0).to_pylist()
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        for at in range(0, len(new), 500):  # few texts are copied at once
            some = new[at : at + 500]
            yield [keys[i] for i in some], b.column(1).take(pa.array(some, pa.int64()))


def _common(rows: DataFrame, chars: int, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles, sorted, by their first bits; in how many texts each is; the bits left out.

    All texts are counted. The bits kept grow with the corpus, so that few
    shingles fall together. Of more than MAX_COMMON the most frequent are taken.
    """
    bits = min(64, max(32, int(chars).bit_length() + 4))
    shift, shards = 64 - bits, max(1, -(-chars // CHARS_A_SHINGLE // SHARD_SHINGLES))
    edges = np.array([(s << bits) // shards for s in range(1, shards)], U)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([*held, np.zeros(0, U)]) >> U(shift), return_counts=True)
            cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            parts = [(s, keys[a:b], n[a:b].astype(np.uint32)) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int64()), pa.array([packed(k) for _, k, _ in parts], pa.binary()), pa.array([c.tobytes() for _, _, c in parts], pa.binary())], names=["shard", "keys", "n"])

        for _, texts in _distinct(batches):
            for s in shingle_sets(texts, words):
                held.append(s)
                total += len(s)
                if total >= COUNT_ONCE:
                    yield flush()
                    held, total = [], 0
        yield flush()

    def add(t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x.as_buffer()) for x in t.column("keys")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("n")])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.add.reduceat(n, at)
        often = n >= COMMON
        return pa.table({"s": pa.array(keys[at][often].view(np.int64)), "n": pa.array(n[often])})

    found = stage(rows.select("key", "text").mapInArrow(count, "shard long, keys binary, n binary").groupBy("shard").applyInArrow(add, "s long, n long"))
    most = found.orderBy(F.col("n").desc(), "s").limit(MAX_COMMON).toArrow()
    drop_stage(found)
    release(rows.sparkSession)
    s, n = most.column("s").to_numpy().view(U), most.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], np.minimum(n[order], (1 << 32) - 1).astype(np.uint32), shift


def _met(rows: DataFrame, chars: int, words: int) -> DataFrame:
    """shingle, key, size, own, and first_key, first_size, first_own: the texts that meet on a shingle, each beside its head.

    The head is the text with the fewest shingles of its own, then the least
    key. A shingle in more than a shard's entries is dealt over several shards;
    what meets there is beside the head there, and those heads are beside the
    head of all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, chars, words))
    shards = max(1, -(-chars // CHARS_AN_ENTRY // SHARD_ENTRIES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, shift = shared.value
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate([x for x, _ in held] or [np.zeros(0, ENTRY)])
            often = np.concatenate([x for _, x in held] or [np.zeros(0, np.uint32)]).astype(U)
            parts = np.minimum(often // U(max(1, SHARD_ENTRIES // 4)) + U(1), U(shards))
            salt = (mixed(e["key"].view(U)) >> U(32)) * parts >> U(32)
            shard = (((e["shingle"] >> U(32)) + salt) % U(shards)).astype(np.int64)
            order = np.lexsort((e["shingle"], shard))
            e, shard = e[order], shard[order]
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(e) else np.zeros(0, np.int64)
            parts = np.split(e, at[1:]) if len(e) else []
            column = lambda f: pa.array([f(x) for x in parts], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(shard[at]), column(lambda x: packed(x["shingle"])), column(lambda x: x["key"].tobytes()), column(lambda x: planes(x["size"])), column(lambda x: planes(x["own"]))], names=["shard", *ENTRY.names])

        for keys, texts in _distinct(batches):
            for key, s in zip(keys, shingle_sets(texts, words), strict=True):
                first, often = prefix(s, common, counts, shift)
                e = np.empty(len(first), ENTRY)
                e["shingle"], e["key"], e["size"], e["own"] = first, key, len(s), (often == 0).sum()
                held.append((e, often))
                total += len(e)
                if total >= AT_ONCE:
                    yield flush()
                    held, total = [], 0
        yield flush()

    def meet(t: pa.Table) -> pa.Table:
        e = np.concatenate([_entries(*(t.column(c)[i].as_buffer() for c in ENTRY.names)) for i in range(t.num_rows)])
        e = e[np.lexsort((e["key"], e["own"], e["shingle"]))]
        new = np.r_[True, (e["shingle"][1:] != e["shingle"][:-1]) | (e["key"][1:] != e["key"][:-1])]
        e = e[new]
        at = np.flatnonzero(np.r_[True, e["shingle"][1:] != e["shingle"][:-1]])
        sizes = np.diff(np.r_[at, len(e)])
        first, several = e[np.repeat(at, sizes)], np.repeat(sizes, sizes) > 1
        if shards > 1:  # a lone entry may be one part of a shingle that is dealt over shards
            common, counts, shift = shared.value
            hot = common[counts >= max(1, SHARD_ENTRIES // 4)]
            several |= np.isin(e["shingle"] >> U(shift), hot)
        e, first = e[several], first[several]
        c = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        return pa.table({**{k: c(e[k]) for k in ENTRY.names}, **{f"first_{k}": c(first[k]) for k in ENTRY.names[1:]}})

    sent = rows.select("key", "text").mapInArrow(send, "shard long, shingle binary, key binary, size binary, own binary")
    schema = ", ".join(f"{k} long" for k in [*ENTRY.names, *(f"first_{k}" for k in ENTRY.names[1:])])
    met = stage(sent.groupBy("shard").applyInArrow(meet, schema))
    shared.destroy()
    release(met.sparkSession)
    heads = met.groupBy("shingle").agg(F.min(F.struct("first_own", "first_key", "first_size")).alias("f"), F.min("first_key").alias("l"), F.max("first_key").alias("h")).where("l <> h")
    others = met.where("key = first_key").join(heads.select("shingle", "f"), "shingle").where(F.col("key") != F.col("f.first_key"))
    return met.unionByName(others.select(*ENTRY.names, *[F.col(f"f.first_{k}").alias(f"first_{k}") for k in ENTRY.names[1:]]))


def _possible(size_a: str, size_b: str) -> Column:
    """Whether two sets of these sizes can be near; a test of the pair alone, so that it drops all hits of a pair or none."""
    a, b = F.col(size_a), F.col(size_b)
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _enough(hits: Column | str, size_a: str, size_b: str) -> Column:
    """Whether two sets of these sizes can be near if their prefixes share no more than `hits` shingles.

    The prefix that ends first holds all that its set shares with the other so
    far; beyond it lie that set's remaining ceil(0.8 size) - 1 shingles.
    """
    a, b = F.col(size_a), F.col(size_b)
    beyond = F.ceil(F.greatest(a, b) * NUMERATOR / DENOMINATOR) - 1
    return ((F.col(hits) if isinstance(hits, str) else hits) + beyond) * (NUMERATOR + DENOMINATOR) >= (a + b) * NUMERATOR


def _verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) that are near; texts are read again and compared as sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1), words)], pa.binary())], names=["key", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * DENOMINATOR >= (len(x) + len(y) - both) * NUMERATOR)
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    pairs = stage(pairs)
    used = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    texts = rows.select("key", "text").join(F.broadcast(used) if used.count() <= BROADCAST_ROWS else used, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    s = stage(texts.mapInArrow(sets, "key long, s binary"))
    both = pairs.join(s.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    near = stage(both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"))
    for done in (s, used, pairs):
        drop_stage(done)
    return near


def _candidates(pairs: DataFrame) -> DataFrame:
    """a, b of those rows (a, b, sa, sb, hits) that can be near by the sum of their hits, the shingles that both prefixes hold; written."""
    hits = pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    return stage(hits.where(_enough("hits", "sa", "sb")).select("a", "b"))


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """shingle, key, size, own, label of the entries whose shingle is held by several components of the links found so far; written."""
    labels = components(found).select(F.col("v").alias("key"), "p")
    m = met.join(labels, "key", "left").select("shingle", "key", "size", "own", F.coalesce("p", "key").alias("label"))
    several = m.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("shingle")
    return stage(m.join(several, "shingle", "left_semi"))


def _apart(x: DataFrame, major: DataFrame) -> DataFrame:
    """a, b, sa, sb, hits of texts that meet on the entries x and are of different components; hits of a pair may come in parts.

    Of two such texts one at least is outside of the component that most on the
    shingle belong to, and two texts share no more shingles than either shares
    with any. On shingles that up to BIG texts share, each pair is a row. On
    others, each text outside is set against the rest in blocks: its shared
    shingles are counted there, and only pairs that can be near come out.
    """
    x = stage(x.join(major.select("shingle", "major", (F.col("n") > BIG).alias("big")), "shingle"))
    seen = x.groupBy("key").agg(F.count(F.lit(1)).alias("most"), F.sum((~F.col("big") | (F.col("label") == F.col("major"))).cast("long")).alias("elsewhere"))
    entries = stage(x.join(seen, "key"))
    outside = entries.where("label <> major").select("shingle", "big", *[F.col(c).alias(f"{c}_b") for c in ("key", "size", "label", "most", "elsewhere")])
    once = (F.col("label") == F.col("major")) | (F.col("key") < F.col("key_b"))
    can = _possible("size", "size_b") & _enough(F.least("most", "most_b"), "size", "size_b")
    pair = [F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b"), F.col("size").alias("sa"), F.col("size_b").alias("sb")]
    rows = entries.where(~F.col("big")).join(outside.where(~F.col("big")).drop("big"), "shingle").where((F.col("label") != F.col("label_b")) & once & can).select(*pair, F.lit(1).cast("long").alias("hits"))
    most = major.agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-int(most) // BLOCK)))).alias("block")
    lists = entries.where("big").groupBy("shingle", block).agg(F.collect_list(F.struct("key", "size", "label", (F.col("label") == F.col("major")).alias("in_major"))).alias("texts"))
    met = lists.join(outside.where("big").drop("big", "most_b"), "shingle").drop("shingle")

    def count(t: pa.Table) -> pa.Table:
        own = {c: t.column(f"{c}_b")[0].as_py() for c in ("key", "size", "label", "elsewhere")}
        e = pa.concat_arrays([c.flatten() for c in t.column("texts").chunks])
        key, size, label = (e.field(c).to_numpy() for c in ("key", "size", "label"))
        once = e.field("in_major").to_numpy(zero_copy_only=False) | (key < own["key"])  # else it counts where the other one is outside
        ok = (label != own["label"]) & (np.minimum(size, own["size"]) * DENOMINATOR >= np.maximum(size, own["size"]) * NUMERATOR)
        key, at, place, shared = np.unique(key[ok], return_index=True, return_inverse=True, return_counts=True)
        size, hits = size[ok][at], np.bincount(place, once[ok], len(key)).astype(np.int64)
        beyond = -(-np.maximum(size, own["size"]) * NUMERATOR // DENOMINATOR) - 1
        near = (shared + own["elsewhere"] + beyond) * (NUMERATOR + DENOMINATOR) >= (size + own["size"]) * NUMERATOR
        near &= hits > 0
        key, size, hits = key[near], size[near], hits[near]
        return pa.table({"a": np.minimum(key, own["key"]), "b": np.maximum(key, own["key"]), "sa": size, "sb": np.full(len(key), own["size"]), "hits": hits})

    return rows.unionByName(met.groupBy("key_b", "block").applyInArrow(count, "a long, b long, sa long, sb long, hits long"))


def links(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """a, b: links between keys of rows (key, text) that have the same components as all near pairs; each is verified. Written; what led to it is deleted.

    First come the pairs that op5's fingerprints link, over shingles of `words`
    words, and the texts that share a rare shingle with a head. Most pairs at
    this similarity are beyond the fingerprints' radius; they are completed.
    While what meets on some shingles is many times as many pairs as entries,
    as in a large group whose members are near by chance, each text is compared
    with a few more: another member of each shingle is its head, and a text takes
    the HEADS heads that it has most shingles in common with. Pairs that are
    unconnected when that no longer helps are compared one by one.
    """
    since = n_staged()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    met = _met(rows, chars, words)
    # hits with the least key only: too few for some pairs, which are left to the later passes
    stars = met.where((F.col("key") != F.col("first_key")) & _possible("size", "first_size"))
    heads = _candidates(stars.select(F.col("first_key").alias("a"), F.col("key").alias("b"), F.col("first_size").alias("sa"), F.col("size").alias("sb"), F.lit(1).alias("hits")))
    tried = stage(heads.union(near_keys(rows.select("key", "text"), words)).distinct())
    found, left, k = _verified(tried, rows, words), None, 0
    while True:
        x = _open(met, found)
        by_label = x.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
        major = by_label.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").cast("double").alias("n"), F.max("n").alias("most"))
        n, pairs = major.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - F.col("most")))).first()
        if not n or pairs <= MANY_PAIRS * n or (left is not None and pairs > 0.75 * left):
            break
        left, k = pairs, k + 1
        order = F.xxhash64("key", F.lit(k))
        heads = x.groupBy("shingle").agg(F.min_by(F.struct("key", "size", "label"), order).alias("h"), F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_PAIRS)
        beside = x.join(heads, "shingle").where((F.col("label") != F.col("h.label")) & _possible("size", "h.size")).groupBy("key", F.col("h.key").alias("head")).agg(F.count(F.lit(1)).alias("hits"))
        some = beside.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("hits", "head")), asc=False), 1, HEADS).alias("heads"))
        some = some.select("key", F.explode("heads.head").alias("head"))
        more = stage(some.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        found, tried = stage(found.union(_verified(more, rows, words))), tried.union(more)
        drop_stage(x)
    apart = _candidates(_apart(x, major))
    drop_stage(x)
    out = stage(found.union(_verified(apart.join(tried, ["a", "b"], "left_anti"), rows, words)))
    drop_stages(rows.sparkSession, since, out)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, component_id for every row of df.

    component_id is the smallest doc_id that can be reached over pairs of texts
    whose sets of word shingles have a Jaccard similarity of at least
    NUMERATOR / DENOMINATOR, itself included. Texts without words, null ones
    too, are copies of each other. Rows without doc_id take part in links;
    their component_id is null if nothing reached has an id. Equal texts (by
    64 bits of a hash) are one node. Other columns are ignored.
    """
    blank = F.coalesce(df[text], F.lit(""))
    key = F.when(blank.rlike(WORD_RE), F.xxhash64(blank)).otherwise(F.lit(0).cast("long"))
    rows = df.select(df[doc_id].alias("doc_id"), key.alias("key"), blank.alias("text"))
    near = links(rows.select("key", "text"), words)
    labels = components(near)
    drop_stage(near)
    nodes = stage(rows.groupBy("key").agg(F.min("doc_id").alias("first")))
    out = named(nodes, labels)
    return rows.select("doc_id", "key").join(F.broadcast(out) if nodes.count() <= BROADCAST_ROWS else out, "key").select("doc_id", "component_id")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of df, one for each group of near_duplicates(), as simhash.kept_rows() keeps them."""
    return kept_rows(df, near_duplicates(df, doc_id, text, words), doc_id)
