"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page_id and payload digest. A shard begins where
the exact running sum of sizes in that order passes a multiple of the shard's
size, however ids are spread; so the shards, the files they are rolled into,
and every byte in them are the same in each run. A file is written under a
temporary name and renamed when it is complete; a task that runs again writes
the same bytes in its place. The manifest, a table that Spark commits as a
whole, names the files that belong to the archive; readers see no others, and
what failed attempts have left is deleted after it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Smaller payloads are always stored.
MIN_REVISIT_BYTES = 100
#: Uncompressed bytes of a shard, compressed bytes after which a file is rolled.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: Shards, each a task, that one job has at most; an archive of more than so many (6.4 TB) has larger ones.
MAX_SHARDS = 100_000
#: A table of repeated payloads of up to so many rows (some 30 MB) is broadcast.
BROADCAST_ROWS = 200_000
#: Where null ids stand in the order.
NULL_ID = -(1 << 63)
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page_id long, last_page_id long"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _headers(first: str, pairs: list[tuple[str, object]]) -> bytes:
    return "".join([f"{first}\r\n", *[f"{k}: {v}\r\n" for k, v in pairs if v is not None], "\r\n"]).encode()


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, refers_to_url: str | None, date: str = DATE) -> bytes:
    """One record; without payload a revisit, whose block keeps the HTTP headers of the full one."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n)])
    revisit = payload is None
    block = http + (payload or b"")
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("WARC-Refers-To-Target-URI", _uri(refers_to_url, refers_to)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", refers_to)] if revisit else []
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)),
        *more,
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _headers("WARC/1.1", head) + block + b"\r\n\r\n"


def payloads(df: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, n, digest, and d, a long that is ordered like the digests."""
    p = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"), F.coalesce(df[html], F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    return p.withColumn("d", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))


def repeated(ids: DataFrame) -> DataFrame:
    """d, first, first_url of the payloads that several rows of (page_id, url, n, digest) hold.

    A payload that a third of all pages share is one row a task here. The table
    is to be joined as a broadcast up to BROADCAST_ROWS, beyond that in a
    shuffled join that Spark can split.
    """
    r = ids.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count("*").alias("c"))
    return r.where((F.col("c") > 1) & (F.col("n") >= MIN_REVISIT_BYTES) & F.col("first").isNotNull()).select(F.col("digest").alias("repeated"), "first", "first_url")


def _keys(page_id: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Byte strings in the order of (page_id, d)."""
    out = np.empty((len(d), 2), ">u8")
    out[:, 0], out[:, 1] = page_id.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), d.astype(np.int64).view(np.uint64)
    return out.view("S16").ravel()


def _bounds(ids: DataFrame, shard_bytes: int) -> np.ndarray:
    """The key of the first record of each shard.

    The sort is one over ids and sizes, without payloads. What a record comes
    after does not depend on where the sort has cut its partitions.
    """
    sized = ids.select(F.coalesce("page_id", F.lit(NULL_ID)).alias("page_id"), "d", (F.col("n") + 600).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MAX_SHARDS))
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sized = stage(sized.repartitionByRange(parts, "page_id", "d").withColumn("part", F.spark_partition_id()))
    sums, before = sorted(map(tuple, sized.groupBy("part").agg(F.sum("size")).collect())), []
    for part, n in sums:  # at most as many as there are partitions
        before.append((part, sum(before[-1][1:]) if before else 0, n))
    starts = F.broadcast(ids.sparkSession.createDataFrame([(p, a) for p, a, _ in before], "part int, start long"))
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("page_id", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sized.withColumn("upto", upto).join(starts, "part").withColumn("shard", F.floor((F.col("start") + F.col("upto") - F.col("size")) / F.lit(shard_bytes)))
    first = placed.groupBy("shard").agg(F.min(F.struct("page_id", "d")).alias("k")).select("k.*").toArrow()
    drop_stage(sized)
    return np.unique(_keys(first.column("page_id").to_numpy(), first.column("d").to_numpy()))


def write(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6, date: str = DATE) -> DataFrame:
    """Write the archive under the URI `path`; returns its manifest, one row a file.

    page_ids are longs, or cast to such. Null payloads are empty, null urls
    stand as urn:page:ID, null page_ids come first. Rows that repeat a page_id
    follow each other; if they repeat the payload too, they are in one shard,
    and each is a response when the id is the smallest of its group. A payload
    is in memory as a whole. Other columns are ignored. An empty table makes an
    empty manifest.
    """
    spark = df.sparkSession
    p = payloads(df, page_id, url, html)
    ids = stage(p.drop("payload"))
    bounds = _bounds(ids, shard_bytes)
    again = stage(repeated(ids))
    c = p.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, F.col("digest") == F.col("repeated"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    shared = spark.sparkContext.broadcast(bounds)  # 16 bytes a shard

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(shared.value, _keys(page_id.to_numpy(), d.to_numpy()), "right") - 1, 0).astype(np.int32))

    c = c.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(NULL_ID)), "d"))
    c = c.select("shard", "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"))
    c = c.repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, root = afs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        at, seq, out, done = None, 0, None, []

        def close():
            nonlocal out
            if out:
                out["stream"].close()
                name = f"{root}/{out['name']}"
                if fs.get_file_info(name).type != afs.FileType.NotFound:  # of an attempt before; some file systems don't move onto a file
                    fs.delete_file(name)
                fs.move(out["temp"], name)
                done.append((out["name"], at, out["records"], out["bytes"], out["sha"].hexdigest(), out["first"], out["last"]))
                out = None

        def put(data):
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != at:
                    close()
                    at, seq = r["shard"], 0
                member = _member(record(r["page_id"], r["url"], r["payload"], r["n"], r["digest"], r["refers_to"], r["refers_to_url"], date), level)
                if out and out["bytes"] + len(member) > roll_bytes:
                    close()
                    seq += 1
                if not out:
                    name = f"pages-{at:06d}-{seq:05d}.warc.gz"
                    temp = f"{root}/.tmp-{attempt}-{name}"
                    out = {"name": name, "temp": temp, "stream": fs.open_output_stream(temp, compression=None), "sha": hashlib.sha256(), "records": 0, "bytes": 0, "first": r["page_id"], "last": None}
                    info = b"software: echogrid\r\nformat: WARC File Format 1.1\r\n"
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
                    put(_member(_headers("WARC/1.1", head) + info + b"\r\n\r\n", level))
                put(member)
                out["records"] += 1
                out["last"] = r["page_id"]
        close()
        names = ("file", "shard", "records", "bytes", "sha256", "first_page_id", "last_page_id")
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

    c.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    drop_stage(ids)
    drop_stage(again)
    _tidy(path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _tidy(path: str) -> None:
    """Delete what failed attempts have left under temporary names."""
    from pyarrow import fs as afs

    fs, root = afs.FileSystem.from_uri(path)
    for info in fs.get_file_info(afs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(".tmp-"):
            fs.delete_file(info.path)


def _lines(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz with a member a record; digests of blocks are verified."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("the file ends inside a record")
                return
            parts.append(z.decompress(rest))
            rest = z.unused_data
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        headers = _lines(head)
        block = body[: int(headers["Content-Length"])]
        if body[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if (want := headers.get("WARC-Block-Digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("a block's digest is wrong")
        yield headers, block


def read(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload] of the archive's records."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, root = afs.FileSystem.from_uri(path)

        def batch(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6 + keep_payload)], names=names[: 6 + keep_payload])

        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n, digest = int(_lines(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload's digest is wrong")
                        number = lambda k: int(h[k]) if k in h else None
                        rows.append((number("X-Page-ID"), h["WARC-Target-URI"], h["WARC-Type"], n, digest, number("X-Refers-To-Page-ID"), payload if keep_payload else None))
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    files = manifest.count()
    return manifest.repartition(max(1, files), "file").mapInArrow(run, schema)
