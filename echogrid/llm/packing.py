"""Best-fit packing of tokenised documents into sequences.

Large-item matching: pieces above a third of the capacity fit at most twice
into a sequence and are paired greedily, each with the largest partner that
still fits; smaller pieces then fill the remaining gaps, best fit first.

Only lengths decide where a piece may go, so the packing itself is worked out
on the histogram of lengths (at most `capacity` numbers, whatever the size of
the corpus), as a list of runs: "pieces number lo to hi of this length go to
the sequences from base on, so many to each, at this offset". Every piece then
finds its place from its number among the pieces of its length. It is the
packing of all documents together, and no task ever holds more than a run list
and its own documents.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

CAPACITY = 1024
END_ID = 2
#: Up to so many rows (some MB) of starting numbers are broadcast.
BROADCAST_ROWS = 200_000

#: White space that is this long is left to the library that takes any.
LONG_BLANK = 10_000
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")

_encodings: dict = {}


def encoding(path: str | None = None):
    """The tokenizer of a .tiktoken rank file, by default the public 50k byte-level BPE.

    It gives the ids that `tokenizers` gives with the same vocabulary (file
    byte_bpe_50k.json), in a fifth of the time; the tests compare them.
    """
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encodings[path]


def plain_encoding(path: str | None = None):
    """The same tokenizer by the other library, which needs no stack for runs of white space."""
    if ("plain", path) not in _encodings:
        import public_tokenizers
        from tokenizers import Tokenizer

        rank_file = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        _encodings["plain", path] = Tokenizer.from_file(rank_file.removesuffix(".tiktoken") + ".json")
    return _encodings["plain", path]


def token_ids(text: str | None, end_id: int = END_ID, path: str | None = None) -> np.ndarray:
    """The ids of a whole text, then the end's.

    A text with a run of LONG_BLANK white space or more is handed to
    `tokenizers`: the pattern of the faster library goes back through such a
    run with a stack that overflows at about a million.
    """
    text = text or ""
    if _LONG_BLANK.search(text):
        return np.array([*plain_encoding(path).encode(text, add_special_tokens=False).ids, end_id], dtype="<u4")
    e = encoding(path)
    ids = e.encode(text, allowed_special="all") if "<|endoftext|>" in text else e.encode_ordinary(text)
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens; the first takes what is over."""
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, edges[1:], strict=False))


def pieces(df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, number[, ids]: the pieces of every row.

    part is the task that made the row and number counts the pieces of equal
    length in it; both are stored, so they hold when tasks are run again. A
    text's ids are in memory at once, some 40 bytes a token.
    """
    fields = [T.StructField("doc_id", df.schema[doc_id].dataType), *[T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("number", T.LongType()))]]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, all_ids = [], [np.zeros(0, np.int32)]
            for i, t in enumerate(batch.column(1)):
                ids = token_ids(t.as_py(), end_id, path)
                for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
                if keep_ids:
                    all_ids.append(ids.view("<i4"))
            c = np.array(rows, np.int64).reshape(-1, 7).T
            out = [batch.column(0).take(pa.array(c[0])), pa.array(c[1].astype(np.int32)), *[pa.array(x) for x in c[2:5]], pa.array(c[5].astype(np.int32)), pa.array(c[6])]
            names = [f.name for f in fields]
            if keep_ids:  # a document's pieces follow each other
                out.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(c[3])].astype(np.int32), pa.array(np.concatenate(all_ids))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(df[doc_id], df[text]).mapInArrow(run, T.StructType(fields))


def runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, base, per, offset): where the pieces lo <= number < hi of a length go.

    Piece lo + j goes to sequence base + j // per, at offset + (j % per) * length.
    """
    left, used, out = {n: c for n, c in histogram.items() if c}, {}, []
    gaps: list[tuple[int, int, int]] = []  # (gap, base, sequences), sorted
    sequences = 0

    def place(length: int, base: int, n: int, per: int, offset: int) -> None:
        lo = used.get(length, 0)
        out.append((length, lo, lo + n * per, base, per, offset))
        used[length] = lo + n * per
        left[length] -= n * per

    def opened(n: int) -> int:
        nonlocal sequences
        sequences += n
        return sequences - n

    def gap(size: int, base: int, n: int) -> None:
        if size and n:
            insort(gaps, (size, base, n))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            # the largest partner that fits and is left
            b = next((large[i] for i in range(bisect_left(large, capacity - a + 1) - 1, -1, -1) if left[large[i]] > (large[i] == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            base = opened(n)
            place(a, base, n, 1, 0)
            if b is not None:
                place(b, base, n, 1, a)
            gap(capacity - a - (b or 0), base, n)
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            i = bisect_left(gaps, (a,))
            size, base, n = gaps.pop(i) if i < len(gaps) else (capacity, opened(k := -(-left[a] // (capacity // a))), k)
            per = min(size // a, left[a])
            k = min(n, left[a] // per)
            place(a, base, k, per, capacity - size)
            gap(size - per * a, base, k)
            gap(size, base + k, n - k)
    return out


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids] for every piece of every row.

    Sequences hold at most `capacity` tokens and have no gaps before their
    last piece. Only documents longer than that are cut. Null and empty texts
    are the end id alone. Repeated rows are packed as often as they occur. All
    other columns are ignored, so their names don't matter. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    p = stage(pieces(df, doc_id, text, capacity, end_id, path, keep_ids))
    counts = stage(p.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    schema = "length long, lo long, hi long, base long, per long, offset0 long"
    # one run for each length or gap that is used up: a few thousand rows at most
    where = F.broadcast(spark.createDataFrame(runs(histogram, capacity), schema))
    p = p.join(starts, ["part", "length"]).withColumn("at", F.col("number") + F.col("first"))
    p = p.alias("p").join(where.alias("w"), (F.col("p.length") == F.col("w.length")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    j = F.col("at") - F.col("lo")
    sequence = F.col("base") + F.floor(j / F.col("per"))
    offset = F.col("offset0") + F.pmod(j, F.col("per")) * F.col("p.length")
    return p.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of pack(keep_ids=True): the sequences themselves, each at most `capacity` ids."""
    s = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("s"))
    return s.select("sequence_id", F.flatten(F.col("s")["ids"]).alias("ids"), F.col("s")["doc_id"].alias("doc_ids"))
