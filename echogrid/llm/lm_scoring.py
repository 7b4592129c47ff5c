"""LM scoring with a log-frequency Bloom filter of quantised bigram counts.

A bigram seen c times is entered as the events (bigram, 1) ... (bigram, q),
where q is the level of c on a logarithmic scale. Workers hold the filter as a
broadcast and find a count by probing level after level until the first miss,
so an error of the filter rarely raises a count by more than a level. The
probability of a word w after v is

    P(w | v) = s * count(v w) / c(v) + (1 - s * k) * (c(w) + 0.1) / (N + 0.1 * (V + 1))

with the least count of the level found, the exact unigram counts c, and
1 - s the Good-Turing mass of unseen bigrams (those seen once, by all) for
contexts of about the frequency of v. k is the share of the counts of such
contexts' bigrams that the least counts of their levels keep, so what
quantisation takes from a context goes to the back-off; over all w the sum is
one on average, apart from false positives.

The words' counts and the filter grow with the corpus. Together they are
broadcast up to MAX_BROADCAST bytes, which is checked. Beyond that the filter,
and the counts too if they alone are larger, stay in the shards in which they
were made: each block of text sends its distinct keys to their shards, is
answered there from the same table and the same piece of the filter, and gets
equal scores; nothing is larger than a shard or a block. A shard looks up what
all blocks ask in one go, so its work grows with the keys; blocks times shards
are only messages. This is done for a part of the rows at a time, whose
shuffles are let go before the next one.

Every count covers all training rows. Each task counts what it has read and
sends sorted keys, cut by their hash into shards of bounded size; a shard adds
them up, and the bigram shards turn into pieces of the filter right there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_stage, packed, planes, release, stage, unpacked, unplanes

U = np.uint64
#: Added to counts in the unigram distribution.
ADD = 0.1
#: Base of the logarithmic scale of counts; hash functions and bits of the filter for each event (false positives: 0.9 %).
LOG_BASE, HASHES, BITS = 1.5, 6, 10
#: Bytes of text that are hashed at once (some 50 bytes each), tokens from which a block of the sharded route is full.
CHUNK, BLOCK = 1 << 18, 600_000
#: Keys that a task gathers before it sends them, tokens a shard.
GATHER, SHARD_TOKENS = 1_500_000, 1_500_000
#: Bytes of word counts and filter that are broadcast at most.
MAX_BROADCAST = 256 << 20
#: Parts of the rows, by a hash of their text, that the sharded route works on one after the other: what it shuffles and writes is of one part at a time.
PASSES = 4
#: Shards that the driver fetches at once.
SLICE = 8
#: Classes of context frequency, by powers of two.
CLASSES = 64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) % (1 << 64) | 1 for i in range(HASHES)], U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * _C3
    return x ^ (x >> U(31))


END, BEGIN = mixed(np.array([1], U))[0], mixed(np.array([2], U))[0]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mixed(np.arange(256, dtype=U) + U(1000))
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def tokens(texts: pa.StringArray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens of each row, hashes of all tokens) for runs of rows of about `chunk` bytes.

    A word is known by 64 bits: a polynomial over its bytes. Each row ends with
    the token END; null rows have no other.
    """
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        buf, o = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        word = ~_SPACE[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins, ends = o[:-1][o[1:] > o[:-1]], o[1:][o[1:] > o[:-1]]
        first[begins], last[ends - 1] = word[begins], word[ends - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_table(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U)
        np.cumsum(_LETTER[buf] * up[: len(buf)], out=total[1:])
        h = mixed((total[b] - total[a]) * down[a] + (b - a).astype(U) * _C1)
        n = np.diff(np.searchsorted(a, o))
        out = np.empty(len(h) + len(n), U)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        out[np.cumsum(n + 1) - 1] = END
        yield row, n + 1, out
        row = stop


def _before(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[np.cumsum(n) - n] = BEGIN
    return v


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)]) if counts is None else np.add.reduceat(counts, at) if len(at) else counts


class Table:
    """Counts of words by their hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.bits = self.index_bits(len(keys))
        self.starts = np.empty(1 << self.bits, np.uint32 if len(keys) < 1 << 32 else np.int64)
        for a in range(0, 1 << self.bits, 1 << 16):  # in parts: the driver has little memory beside the table
            b = min(a + (1 << 16), 1 << self.bits)
            self.starts[a:b] = np.searchsorted(keys, np.arange(a, b, dtype=U) << U(64 - self.bits))

    @staticmethod
    def index_bits(n: int) -> int:
        """Two to four keys share an entry of the index."""
        return max(1, n.bit_length() - 2)

    @classmethod
    def size(cls, n: int, most: int) -> int:
        """Bytes of n keys, their counts up to `most`, and the index."""
        return n * (12 if most < 1 << 32 else 16) + ((4 if n < 1 << 32 else 8) << cls.index_bits(n))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = self.starts[h >> U(64 - self.bits)].astype(np.int64)
        at[at == len(self.keys)] = 0
        todo = np.arange(len(h))
        while len(todo):  # a few steps: hashes are spread evenly
            here = at[todo]
            todo = todo[(self.keys[here] < h[todo]) & (here + 1 < len(self.keys))]
            at[todo] += 1
        return np.where(self.keys[at] == h, self.counts[at], 0).astype(np.int64)


def levels() -> np.ndarray:
    """The least count of each level."""
    out, x = [], 1.0
    while x < 1 << 62:
        if not out or int(np.ceil(x)) > out[-1]:
            out.append(int(np.ceil(x)))
        x *= LOG_BASE
    return np.array(out, np.int64)


LEVELS = levels()
#: What is added to a key for each level, from 1.
_LEVEL = np.arange(len(LEVELS) + 1, dtype=U) * _C1


def _class(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(float))[1].astype(np.int64)  # 0 for 0, then 1 + floor(log2 c)


def bigram_keys(v: np.ndarray, w: np.ndarray, context_class: np.ndarray) -> np.ndarray:
    """58 bits of a hash of the pair, then the class of the context's frequency."""
    return (mixed(v * _C1 + w) & ~U(CLASSES - 1)) | context_class.astype(U)


def _bits(keys: np.ndarray, level: int, size: np.ndarray | int):
    x = mixed(keys + _LEVEL[level])
    for odd in _ODD:
        yield ((x * odd) >> U(32)) * size >> U(32)


class Filter:
    """The filter, in pieces: a bigram's piece is chosen by the first bits of its key."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray):
        """sizes: bits of each piece, multiples of eight; data: the bytes of all."""
        self.sizes, self.data = sizes.astype(U), data
        self.starts = (np.cumsum(sizes) - sizes).astype(U)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The least count of the highest level that answers, by probing from the first."""
        out, todo = np.zeros(len(keys), np.int64), np.arange(len(keys))
        piece = _shard(keys, len(self.sizes))
        todo = todo[self.sizes[piece] > 0]
        for j, least in enumerate(LEVELS):
            if not len(todo):
                break
            k, p = keys[todo], piece[todo]
            x, size, start = mixed(k + _LEVEL[j + 1]), self.sizes[p], self.starts[p]
            for odd in _ODD:
                at = start + (((x * odd) >> U(32)) * size >> U(32))
                hit = (self.data[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    todo, x, size, start = todo[hit], x[hit], size[hit], start[hit]
            out[todo] = least
        return out


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _blobs(gathered: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """A row a shard: the keys seen once, the others, and their counts."""
    keys, counts = _summed(np.concatenate(gathered))
    cut = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
    rows = [(s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    once = [c == 1 for _, _, c in rows]
    blob = lambda xs: pa.array(list(xs), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _, _ in rows], pa.int32()), blob(packed(k[o]) for (_, k, _), o in zip(rows, once, strict=True)), blob(packed(k[~o]) for (_, k, _), o in zip(rows, once, strict=True)), blob(planes(c[~o]) for (_, _, c), o in zip(rows, once, strict=True))],
        names=["shard", "once", "more", "counts"],
    )


BLOBS = "shard int, once binary, more binary, counts binary"


def _unblob(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    read = lambda c, f: np.concatenate([np.zeros(0, U), *[f(x.as_buffer()) for x in t.column(c)]])
    once, more = read("once", unpacked), read("more", unpacked)
    return _summed(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), read("counts", unplanes).view(np.int64)]))


def _counted(train: DataFrame, shards: int, keys) -> DataFrame:
    """Blobs of keys(hashes, tokens a row) of all rows of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for b in batches:
            for _, per_row, h in tokens(b.column(0)):
                gathered.append(keys(h, per_row))
                n += len(h)
                if n >= GATHER:
                    yield _blobs(gathered, shards)
                    gathered, n = [], 0
        if n:
            yield _blobs(gathered, shards)

    return train.select("text").mapInArrow(run, BLOBS)


def _context_counts(c: np.ndarray, n: np.ndarray, begins: int) -> np.ndarray:
    cv = np.empty_like(c)
    cv[1:] = c[:-1]
    cv[np.cumsum(n) - n] = begins
    return cv


@dataclass(frozen=True)
class Numbers:
    """begins: how often the context before a first word was seen, once a training row; unseen: mass of unseen bigrams by class of context; kept: share of the counts that levels keep."""

    total: int
    distinct: int
    begins: int
    unseen: np.ndarray | None = None
    kept: np.ndarray | None = None

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.total + ADD * (self.distinct + 1)))

    def asked(self, n: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bigrams that may have been seen, and their keys."""
        cv = _context_counts(c, n, self.begins)
        found = np.flatnonzero((cv > 0) & (c > 0))
        return found, bigram_keys(_before(h, n)[found], h[found], _class(cv[found]))

    def scores(self, n: np.ndarray, h: np.ndarray, c: np.ndarray, look: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each row; look gives the counts of bigram keys."""
        base, cv, starts = self.log_base(c), _context_counts(c, n, self.begins), np.cumsum(n) - n
        found, keys = self.asked(n, h, c)
        joint = np.zeros(len(h))
        joint[found] = np.minimum(look(keys), np.minimum(cv[found], c[found]))
        u, kept = self.unseen[_class(cv)], self.kept[_class(cv)]
        p = (1 - u) * joint / np.maximum(cv, 1) + (1 - (1 - u) * kept) * 10.0**base
        total = lambda x: np.add.reduceat(x, starts)
        return n.astype(np.int64), total((c > 0).astype(np.int64)), total(base), total(np.log10(p))


@dataclass(frozen=True)
class Model:
    """Numbers, the two tables of shards, and a broadcast of the word counts, or of both, as far as they fit."""

    numbers: Numbers
    shards: int
    words: DataFrame
    pieces: DataFrame
    shared_table: Broadcast | None = None
    shared_filter: Broadcast | None = None


def _slices(staged: DataFrame, shards: int) -> Iterator[pa.Table]:
    """The rows of a few shards at a time, in order, so that the driver holds little beside what it puts together."""
    for lo in range(0, shards, SLICE):
        yield staged.where((F.col("shard") >= lo) & (F.col("shard") < lo + SLICE)).orderBy("shard").toArrow()


def _runs(texts: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tokens(), gathered to BLOCK tokens."""
    first, ns, hs = 0, [], []
    for row, n, h in tokens(texts):
        ns.append(n)
        hs.append(h)
        if sum(map(len, hs)) >= BLOCK:
            yield first, np.concatenate(ns), np.concatenate(hs)
            first, ns, hs = row + len(n), [], []
    if ns:
        yield first, np.concatenate(ns), np.concatenate(hs)


def _blocks(d: DataFrame, table: Broadcast | None = None) -> DataFrame:
    """block, rows, n, u, i: runs of rows of d (text first) with their distinct tokens u, and each token's place i in u.

    rows holds the other columns. With the table of word counts, also c, the
    counts of u. Written, so that block numbers hold.
    """
    names = ["block", "rows", "n", "u", "i", *(["c"] if table is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            rest = b.select(b.schema.names[1:])
            for row, n, h in _runs(b.column(0)):
                sink = pa.BufferOutputStream()
                if rest.num_columns:
                    with pa.ipc.new_stream(sink, rest.schema) as w:
                        w.write_batch(rest.slice(row, len(n)))
                u, i = np.unique(h, return_inverse=True)
                blobs = [sink.getvalue().to_pybytes(), n.astype(np.int64).tobytes(), u.tobytes(), i.astype(np.uint32).tobytes()]
                if table is not None:
                    blobs.append(table.value(u).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in blobs]], names=names)
                block += 1

    return stage(d.mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in names[1:])))


def _parts(df: DataFrame, text: str) -> list[DataFrame]:
    return [df.where(F.pmod(F.xxhash64(text), F.lit(PASSES)) == k) for k in range(PASSES)]


def _blob(b: pa.RecordBatch | pa.Table, k: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b.column(name)[k].as_buffer(), kind)


def _tokens_of(b: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens a row, hashes and counts of a block."""
    i = _blob(b, k, "i", np.uint32)
    return _blob(b, k, "n", np.int64), _blob(b, k, "u", U)[i], _blob(b, k, "c", np.int64)[i]


def _answers(blocks: DataFrame, held: DataFrame, shards: int, wanted, look, kept=planes) -> DataFrame:
    """block, shard, values: for each block and shard the look(shard's row, keys) of the block's distinct keys there, in order.

    A shard looks up the keys of all blocks at once. wanted(n, h, c) gives a
    block's keys from its tokens; without it they are the words themselves.
    kept writes an answer's numbers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, block in enumerate(b.column("block").to_pylist()):
                keys = _blob(b, k, "u", U) if wanted is None else _summed(wanted(*_tokens_of(b, k)))[0]
                cut = np.searchsorted(_shard(keys, shards), np.arange(shards + 1)) if shards < len(keys) else None
                parts = [(k, keys[i:j]) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i] if cut is not None else [(int(k[0]), v) for k, v in ((_shard(v, shards), v) for v in np.split(keys, np.flatnonzero(np.diff(_shard(keys, shards))) + 1)) if len(v)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([packed(v) for _, v in parts], pa.binary())], names=["shard", "block", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        row = own.slice(0, 1).to_batches()[0] if own.num_rows else None
        keys = [unpacked(k.as_buffer()) for k in asked.column("keys")]
        distinct, at = np.unique(np.concatenate([np.zeros(0, U), *keys]), return_inverse=True)
        found = look(row, distinct)[at]
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        values = [kept(found[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "values": pa.array(values, pa.binary())})

    asked = blocks.select("block", *(["u"] if wanted is None else ["n", "u", "i", "c"])).mapInArrow(ask, "shard int, block long, keys binary")
    return asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(answer, "block long, shard int, values binary")


def _returned(answers: pa.Table, read: Callable[[pa.Buffer], np.ndarray]) -> np.ndarray:
    """The values of all shards; shards follow each other in the order of keys."""
    t = answers.sort_by("shard")
    return np.concatenate([read(pa.py_buffer(b"")), *[read(x.as_buffer()) for x in t.column("values")]])


def _word_look(row: pa.RecordBatch | None, keys: np.ndarray) -> np.ndarray:
    if row is None:
        return np.zeros(len(keys), np.int64)
    own, counts = (np.frombuffer(row.column(c)[0].as_buffer(), d) for c, d in (("keys", U), ("counts", np.int64)))
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, counts[at], 0)


def _filter_look(row: pa.RecordBatch | None, keys: np.ndarray) -> np.ndarray:
    """Levels, a byte each; 0 for none."""
    if row is None:
        return np.zeros(len(keys), np.uint8)
    found = Filter(np.array([row.column("bits")[0].as_py()]), np.frombuffer(row.column("data")[0].as_buffer(), np.uint8)).counts(keys)
    return np.searchsorted(LEVELS, found, "right").astype(np.uint8)


def _with_counts(blocks: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """Blocks with c, the counts of their distinct tokens."""

    def add(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("rows", "n", "u", "i", "c")}})
        return own.select(["block", "rows", "n", "u", "i"]).append_column("c", pa.array([_returned(answers, unplanes).astype(np.int64).tobytes()], pa.binary()))

    answers = _answers(blocks, words, shards, None, _word_look)
    both = stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, "block long, rows binary, n binary, u binary, i binary, c binary"))
    drop_stage(blocks)
    return both


def fit(train: DataFrame, text: str = "text") -> Model:
    """Counts of all rows of train; null and empty texts are a single END each.

    A text is hashed as a whole, some 50 bytes a byte of text; texts of up to
    CHUNK bytes are hashed together.
    """
    spark = train.sparkSession
    train = train.select(train[text].alias("text"))
    size = train.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = int(max(1, -(-size // (6 * SHARD_TOKENS))))

    def add_words(t: pa.Table) -> pa.Table:
        keys, counts = _unblob(t)
        return pa.table({"shard": t.column("shard")[:1], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "n": [int(counts.sum())], "v": [len(keys)], "most": [int(counts.max())]})

    words = stage(_counted(train, shards, lambda h, n: h).groupBy("shard").applyInArrow(add_words, "shard int, keys binary, counts binary, n long, v long, most long"))
    n, v, most = (x or 0 for x in words.agg(F.sum("n"), F.sum("v"), F.max("most")).first())
    end = words.where(F.col("shard") == int(_shard(np.array([END], U), shards)[0])).select("keys", "counts").toArrow()
    begins = int(_word_look(end.to_batches()[0], np.array([END], U))[0]) if end.num_rows else 0
    del end
    numbers = Numbers(n, v, begins)
    table_bytes, shared = Table.size(v, most), None
    if table_bytes <= MAX_BROADCAST:
        keys, counts, at = np.empty(v, U), np.empty(v, np.uint32 if most < 1 << 32 else np.int64), 0
        for t in _slices(words.select("shard", "keys", "counts"), shards):
            for k, c in zip(t.column("keys"), t.column("counts"), strict=True):
                one = np.frombuffer(k.as_buffer(), U)
                keys[at : at + len(one)], counts[at : at + len(one)] = one, np.frombuffer(c.as_buffer(), np.int64)
                at += len(one)
        shared = spark.sparkContext.broadcast(Table(keys, counts))
        del keys, counts

    def pairs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return bigram_keys(_before(h, n), h, _class(_context_counts(shared.value(h), n, begins)))

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = []
        for b in batches:
            for k in range(b.num_rows):
                n, h, c = _tokens_of(b, k)
                gathered.append(bigram_keys(_before(h, n), h, _class(_context_counts(c, n, begins))))
                if sum(map(len, gathered)) >= GATHER:
                    yield _blobs(gathered, shards)
                    gathered = []
        if gathered:
            yield _blobs(gathered, shards)

    def add_pairs(t: pa.Table) -> pa.Table:
        keys, counts = _unblob(t)
        k = (keys & U(CLASSES - 1)).astype(np.int64)
        level = np.searchsorted(LEVELS, counts, "right")
        bits = int(-(-level.sum() * BITS // 8) * 8)
        on = np.zeros(bits, bool)
        for j in range(1, level.max() + 1):
            for at in _bits(keys[level >= j], j, U(bits)):
                on[at] = True
        mass = lambda x: pa.array([np.bincount(k, x, CLASSES).astype(np.int64)], pa.list_(pa.int64()))
        return pa.table({"shard": t.column("shard")[:1], "bits": [bits], "data": [np.packbits(on).tobytes()], "once": mass(counts == 1), "all": mass(counts), "low": mass(LEVELS[level - 1])})

    parts = []
    for part in _parts(train, "text") if shared is None else ():
        counted = _with_counts(_blocks(part), words, shards)
        parts.append(stage(counted.mapInArrow(block_pairs, BLOBS)))
        drop_stage(counted)
        release(spark)
    blobs = _counted(train, shards, pairs) if shared is not None else reduce(DataFrame.union, parts)
    pieces = stage(blobs.groupBy("shard").applyInArrow(add_pairs, "shard int, bits long, data binary, once array<long>, all array<long>, low array<long>"))
    for part in parts:
        drop_stage(part)
    release(spark)
    once, every, low = np.zeros((3, CLASSES))
    for r in pieces.select(F.posexplode(F.arrays_zip("once", "all", "low")).alias("k", "x")).groupBy("k").agg(*[F.sum(f"x.{c}").alias(c) for c in ("once", "all", "low")]).collect():
        once[r["k"]], every[r["k"]], low[r["k"]] = r["once"], r["all"], r["low"]
    filter_bytes = (pieces.agg(F.sum("bits")).first()[0] or 0) // 8
    # half a bigram is added, so that no mass is exactly zero
    numbers = replace(numbers, unseen=np.where(every > 0, np.minimum((once + 0.5) / np.maximum(every, 1), 1.0), 1.0), kept=low / np.maximum(every, 1))
    if shared is None or table_bytes + filter_bytes > MAX_BROADCAST:
        return Model(numbers, shards, words, pieces, shared)
    sizes, data, at = np.zeros(shards, np.int64), np.empty(filter_bytes, np.uint8), 0
    for t in _slices(pieces.select("shard", "bits", "data"), shards):
        for s, bits, d in zip(*[t.column(c) for c in ("shard", "bits", "data")], strict=True):
            sizes[s.as_py()] = bits.as_py()
            data[at : at + bits.as_py() // 8] = np.frombuffer(d.as_buffer(), np.uint8)
            at += bits.as_py() // 8
    return Model(numbers, shards, words, pieces, shared, spark.sparkContext.broadcast(Filter(sizes, data)))


def score(df: DataFrame, model: Model, text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `more`, then n_tokens, n_known, train_tokens, base_score, score, for every row of df.

    Whole texts are scored; null and empty ones are the END token alone. Rows
    that repeat get equal scores. A model of no rows gives every token the
    unigram distribution's one share. Input columns named like an output are
    replaced.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    more = more if more is not None else {c: df[c] for c in df.columns if c not in new}
    d = df.select(df[text].alias("__text"), *[v.alias(k) for k, v in more.items()])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields[1:]) + "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    numbers, names = model.numbers, [*d.columns[1:], *new]

    def columns(parts: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
        n, known, base, full = (np.concatenate(x) for x in zip(*parts, strict=True))
        return [pa.array(n), pa.array(known), pa.array(np.full(len(n), numbers.total, np.int64)), pa.array(base), pa.array(full)]

    if model.shared_filter is not None:
        table, bigrams = model.shared_table, model.shared_filter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    parts = [numbers.scores(n, h, table.value(h), bigrams.value.counts) for _, n, h in tokens(b.column(0))]
                    yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns(parts)], names=names)

        return d.mapInArrow(run, schema)

    kinds = [*list(to_arrow_schema(d.schema).types)[1:], pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        n, h, c = _tokens_of(own, 0)
        values = np.r_[0, LEVELS][_returned(answers, lambda x: np.frombuffer(x, np.uint8))]

        def look(keys: np.ndarray) -> np.ndarray:
            return values[np.unique(keys, return_inverse=True)[1]]

        rows = own.column("rows")[0].as_buffer()
        rest = pa.ipc.open_stream(rows).read_all().columns if rows.size else []
        return pa.Table.from_arrays([*rest, *columns([numbers.scores(n, h, c, look)])], names=names)

    scored = []
    for part in _parts(d, "__text"):
        blocks = _blocks(part, model.shared_table)
        if model.shared_table is None:
            blocks = _with_counts(blocks, model.words, model.shards)
            release(df.sparkSession)
        answers = _answers(blocks, model.pieces, model.shards, lambda n, h, c: numbers.asked(n, h, c)[1], _filter_look, np.ndarray.tobytes)
        scored.append(stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)))
        drop_stage(blocks)
        release(df.sparkSession)
    return reduce(DataFrame.union, scored)
