"""SEG-Y files as a DataFrame source, and the sink that writes them.

Files are read through pyarrow's file systems, so local and remote paths work
alike, in parts of about SPLIT_BYTES and as Arrow batches. Rows hold one trace
each: file, number of the trace, the chosen header fields and the samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Trace header fields of the SEG-Y standard: name, first byte (from 1), bytes. Fixed values.
FIELDS = (
    ("tracl", 1, 4), ("tracr", 5, 4), ("fldr", 9, 4), ("tracf", 13, 4), ("ep", 17, 4), ("cdp", 21, 4), ("cdpt", 25, 4),
    ("trid", 29, 2), ("nvs", 31, 2), ("nhs", 33, 2), ("duse", 35, 2), ("offset", 37, 4), ("gelev", 41, 4), ("selev", 45, 4),
    ("sdepth", 49, 4), ("gdel", 53, 4), ("sdel", 57, 4), ("swdep", 61, 4), ("gwdep", 65, 4), ("scalel", 69, 2), ("scalco", 71, 2),
    ("sx", 73, 4), ("sy", 77, 4), ("gx", 81, 4), ("gy", 85, 4), ("counit", 89, 2), ("wevel", 91, 2), ("swevel", 93, 2),
    ("sut", 95, 2), ("gut", 97, 2), ("sstat", 99, 2), ("gstat", 101, 2), ("tstat", 103, 2), ("laga", 105, 2), ("lagb", 107, 2),
    ("delrt", 109, 2), ("muts", 111, 2), ("mute", 113, 2), ("ns", 115, 2), ("dt", 117, 2), ("gain", 119, 2), ("igc", 121, 2),
    ("igi", 123, 2), ("corr", 125, 2), ("sfs", 127, 2), ("sfe", 129, 2), ("slen", 131, 2), ("styp", 133, 2), ("stas", 135, 2),
    ("stae", 137, 2), ("tatyp", 139, 2), ("afilf", 141, 2), ("afils", 143, 2), ("nofilf", 145, 2), ("nofils", 147, 2), ("lcf", 149, 2),
    ("hcf", 151, 2), ("lcs", 153, 2), ("hcs", 155, 2), ("year", 157, 2), ("day", 159, 2), ("hour", 161, 2), ("minute", 163, 2),
    ("sec", 165, 2), ("timbas", 167, 2), ("trwf", 169, 2), ("grnors", 171, 2), ("grnofr", 173, 2), ("grnlof", 175, 2), ("gaps", 177, 2),
    ("otrav", 179, 2), ("cdp_x", 181, 4), ("cdp_y", 185, 4), ("iline", 189, 4), ("xline", 193, 4), ("shotpoint", 197, 4), ("spscalar", 201, 2),
    ("trunit", 203, 2), ("static_scalar", 215, 2), ("static_field", 233, 4), ("seafloor_field", 237, 4),
)
AT = {name: (byte, size) for name, byte, size in FIELDS}
DEFAULT = ("tracl", "tracr", "fldr", "scalel", "scalco", "sx", "sy", "counit", "delrt", "ns", "dt", "cdp_x", "cdp_y", "iline", "xline")
#: Format code: bytes of a sample.
SIZES = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """Hexadecimal floating point, as big-endian uint32."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    exponent = ((raw >> 24) & 0x7F).astype(float) - 64
    return sign * (raw & 0xFFFFFF) / 2.0**24 * 16.0**exponent


def decoded(data: bytes, code: int) -> np.ndarray:
    if code == 1:
        return ibm_to_float(np.frombuffer(data, ">u4").astype(np.uint32))
    kinds = {2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}
    if code not in kinds:
        raise ValueError(f"sample format {code} is not supported")
    return np.frombuffer(data, kinds[code]).astype(float)


def text_header(data: bytes) -> str:
    """The first 3200 bytes: ASCII, else EBCDIC."""
    head = data[:3200]
    return head.decode("ascii") if all(b < 128 for b in head) else head.decode("cp500")


def file_system(path: str):
    """(file system, path) of a URI or a local path."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def list_files(path: str, suffix: str = "sgy", ending: str = "") -> list[str]:
    """A file itself, the files with the suffix (and the ending before it) in a directory, or what a .txt list names, one a line beside it."""
    from pyarrow import fs as afs

    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == afs.FileType.Directory:
        return sorted(f.path for f in fs.get_file_info(afs.FileSelector(root)) if f.is_file and f.path.endswith(f"{ending}.{suffix}"))
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    if root.endswith(".txt"):
        folder = root.rpartition("/")[0]
        with fs.open_input_stream(root) as f:
            names = f.read().decode().split()
        return [n if n.startswith("/") else f"{folder}/{n}" for n in names]
    return [root]


#: Bytes of a file that one partition reads, and of traces that one batch holds.
SPLIT_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
#: Traces of so many bytes are skipped over, and not read, where only headers are wanted.
SKIP_BYTES = 65_536


def layout(f, size: int) -> tuple[int, int, int, bool]:
    """(first byte of the traces, samples a trace, sample format, whether all traces have one length) from a file's first 3600 bytes."""
    head = f.read(3600)
    ns, code, extended = struct.unpack(">H", head[3220:3222])[0], struct.unpack(">h", head[3224:3226])[0], struct.unpack(">h", head[3504:3506])[0]
    begin = 3600 + 3200 * max(extended, 0)
    return begin, ns, code, (size - begin) % (240 + ns * SIZES.get(code, 4)) == 0


class SegyReader(DataSourceReader):
    """Traces of one length are cut by bytes; a file whose traces differ in length is one partition, read trace by trace."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.ending = options["path"], options.get("suffix", "sgy"), options.get("ending", "")
        self.fields = _fields(options)
        self.with_samples = options.get("samples", "true").lower() != "false"

    def partitions(self):
        fs, _ = file_system(self.path)
        infos = fs.get_file_info(list_files(self.path, self.suffix, self.ending))
        return [InputPartition((i.path, i.size, at)) for i in infos for at in range(0, max(i.size, 1), SPLIT_BYTES)]

    def _batch(self, path: str, numbers: np.ndarray, heads: np.ndarray, samples: list | np.ndarray | None) -> pa.RecordBatch:
        values = [np.ascontiguousarray(heads[:, a - 1 : a - 1 + b]).view(">i4" if b == 4 else ">i2").ravel().astype(np.int32) for a, b in (AT[x] for x in self.fields)]
        kind = pa.list_(pa.float64())
        if samples is None:
            column = pa.nulls(len(numbers), kind)
        elif isinstance(samples, np.ndarray):
            column = pa.ListArray.from_arrays(np.arange(0, samples.size + 1, max(samples.shape[1], 1), dtype=np.int32) if samples.shape[1] else np.zeros(len(numbers) + 1, np.int32), pa.array(samples.ravel()))
        else:
            column = pa.array(samples, kind)
        columns = [pa.array([path] * len(numbers)), pa.array(numbers.astype(np.int32)), *[pa.array(v) for v in values], column]
        return pa.RecordBatch.from_arrays(columns, names=["file", "trace", *self.fields, "samples"])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        path, size, at = partition.value
        fs, _ = file_system(self.path)
        with fs.open_input_file(path) as f:
            if size < 3600:
                return
            begin, ns, code, equal = layout(f, size)
            if not equal:
                yield from self._one_by_one(f, path, begin, ns, code) if at == 0 else ()
                return
            length = 240 + ns * SIZES.get(code, 4)
            k, end = (-(-max(x - begin, 0) // length) for x in (at, min(at + SPLIT_BYTES, size)))
            step = max(1, BATCH_BYTES // length)
            for lo in range(k, end, step):
                numbers = np.arange(lo, min(lo + step, end))
                if self.with_samples or length < SKIP_BYTES:
                    f.seek(begin + lo * length)
                    raw = np.frombuffer(f.read(len(numbers) * length), np.uint8).reshape(-1, length)
                else:
                    raw = np.frombuffer(b"".join(f.read_at(240, begin + int(i) * length) for i in numbers), np.uint8).reshape(-1, 240)
                own = np.ascontiguousarray(raw[:, 114:116]).view(">u2").ravel()
                if ((own != 0) & (own != ns)).any():
                    raise ValueError(f"{path}: trace lengths differ although the file's length fits equal ones")
                yield self._batch(path, numbers, raw, decoded(raw[:, 240:].tobytes(), code).reshape(len(numbers), ns) if self.with_samples else None)

    def _one_by_one(self, f, path: str, begin: int, ns: int, code: int) -> Iterator[pa.RecordBatch]:
        f.seek(begin)
        i, heads, samples, held = 0, [], [], 0
        while len(header := f.read(240)) == 240:
            data = f.read((struct.unpack(">H", header[114:116])[0] or ns) * SIZES.get(code, 4))
            heads.append(np.frombuffer(header, np.uint8))
            samples.append(decoded(data, code) if self.with_samples else None)
            held += len(data)
            if held >= BATCH_BYTES:
                yield self._batch(path, np.arange(i, i + len(heads)), np.array(heads), samples if self.with_samples else None)
                i, heads, samples, held = i + len(heads), [], [], 0
        if heads:
            yield self._batch(path, np.arange(i, i + len(heads)), np.array(heads), samples if self.with_samples else None)


def _fields(options: dict) -> list[str]:
    chosen = options.get("fields", "")
    names = [n for n, _, _ in FIELDS] if chosen == "all" else [x.strip() for x in chosen.split(",") if x.strip()] or list(DEFAULT)
    if unknown := [n for n in names if n not in AT]:
        raise ValueError(f"unknown header fields: {', '.join(unknown)}")
    return names


class SegySource(DataSource):
    """spark.read.format("segy").option("path", ...).option("fields", "tracl,sx,sy" or "all").option("samples", "false")."""

    @classmethod
    def name(cls):
        return "segy"

    def schema(self):
        return "file string, trace int, " + ", ".join(f"{n} int" for n in _fields(self.options)) + ", samples array<double>"

    def reader(self, schema):
        return SegyReader(self.options)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SegySource)
    return spark.read.format("segy").options(path=path, **options).load()


#: First byte and bytes of the binary header's fields that are read. Fixed values.
BINARY = ((3201, 4), (3205, 4), (3209, 4), (3213, 2), (3215, 2), (3217, 2), (3219, 2), (3221, 2), (3223, 2), (3225, 2), (3227, 2), (3229, 2), (3255, 2), (3501, 2), (3503, 2), (3505, 2))


def _heads(spark: SparkSession, path: str, suffix: str, schema: str, rows) -> DataFrame:
    """rows(file, first 3600 bytes) of each file; no more of a file is read."""
    files = [(x,) for x in list_files(path, suffix)]
    d = spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(name) as f:
                    columns = rows(name, f.read(3600))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    return d.mapInArrow(run, schema)


def text_headers(spark: SparkSession, path: str, suffix: str = "sgy") -> DataFrame:
    """file, text of each file."""
    return _heads(spark, path, suffix, "file string, text string", lambda name, head: {"file": [name], "text": [text_header(head)]})


def binary_headers(spark: SparkSession, path: str, suffix: str = "sgy") -> DataFrame:
    """file, key (byte from 1), value: the fields of each file's binary header."""

    def rows(name: str, head: bytes) -> dict:
        values = [int.from_bytes(head[a - 1 : a - 1 + n], "big", signed=n == 4) for a, n in BINARY]
        return {"file": [name] * len(BINARY), "key": np.array([a for a, _ in BINARY], np.int32), "value": np.array(values, np.int32)}

    return _heads(spark, path, suffix, "file string, key int, value int", rows)


def encode_trace(values: dict[str, int], samples: np.ndarray) -> bytes:
    head = bytearray(240)
    for k, v in values.items():
        a, b = AT[k]
        head[a - 1 : a - 1 + b] = struct.pack(">i" if b == 4 else ">h", int(v or 0))
    return bytes(head) + np.asarray(samples, ">f4").tobytes()


def encoded(batch: pa.RecordBatch, names: list[str]) -> Iterator[bytes]:
    """Header and samples of each row of a batch; values that don't fit their field raise an error."""
    samples = batch.column(batch.schema.get_field_index("samples"))
    flat, at = samples.flatten().to_numpy(zero_copy_only=False).astype(">f4").tobytes(), np.r_[0, np.cumsum(samples.value_lengths().fill_null(0).to_numpy())]
    heads = np.zeros((batch.num_rows, 240), np.uint8)
    values = {"ns": np.diff(at)} | {n: batch.column(batch.schema.get_field_index(n)).fill_null(0).to_numpy(zero_copy_only=False) for n in names}
    for name, v in values.items():
        a, size = AT[name]
        v, kind = np.asarray(v).astype(np.int64), np.dtype(">i4" if size == 4 else ">u2" if name == "ns" else ">i2")
        if len(v) and (v.min() < np.iinfo(kind).min or v.max() > np.iinfo(kind).max):
            raise ValueError(f"{name}: a value does not fit {size} bytes")
        heads[:, a - 1 : a - 1 + size] = v.astype(kind).view(np.uint8).reshape(-1, size)
    for i in range(batch.num_rows):
        yield heads[i].tobytes() + flat[4 * at[i] : 4 * at[i + 1]]


def file_head(text: str, ns: int, dt: int, traces: int) -> bytes:
    """Textual and binary header: IEEE floats, revision 1."""
    b = bytearray(400)
    for at, kind, v in ((13, "h", min(traces, 32767)), (17, "H", dt), (21, "H", ns), (25, "h", 5), (29, "h", 4), (55, "h", 1), (301, "H", 256), (303, "h", 1)):
        struct.pack_into(f">{kind}", b, at - 1, v)
    return text.encode("ascii", "replace").ljust(3200)[:3200] + bytes(b)


def write(df: DataFrame, path: str, file: str = "file", order: str = "trace", text: str = "") -> DataFrame:
    """One file for each value of the column `file`, traces in the order of `order`; returns file, traces, bytes.

    Integer columns named like header fields go to the headers. Files are
    written under temporary names and renamed; a task that runs again replaces
    its files by equal ones. A file's traces go through one task as a stream.
    """
    names = [n for n, _, _ in FIELDS if n in df.columns]
    d = df.select(file, order, *[c for c in names if c != order], "samples").repartition(file).sortWithinPartitions(file, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        attempt, out, done = TaskContext.get().taskAttemptId(), None, []

        def close():
            if out:
                out[1].close()
                if fs.get_file_info(f"{root}/{out[0]}").type != afs.FileType.NotFound:  # some file systems don't move onto a file
                    fs.delete_file(f"{root}/{out[0]}")
                fs.move(f"{root}/.tmp-{attempt}-{out[0]}", f"{root}/{out[0]}")
                done.append((out[0], out[2], out[3]))

        for b in batches:
            intervals = b.column(b.schema.get_field_index("dt")).to_pylist() if "dt" in names else [0] * b.num_rows
            for name, dt, data in zip(b.column(0).to_pylist(), intervals, encoded(b, names), strict=True):
                if out is None or out[0] != name:
                    close()
                    stream = fs.open_output_stream(f"{root}/.tmp-{attempt}-{name}", compression=None)
                    head = file_head(text, (len(data) - 240) // 4, int(dt or 0), 1)
                    stream.write(head)
                    out = [name, stream, 0, len(head)]
                out[1].write(data)
                out[2] += 1
                out[3] += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "traces", "bytes"])

    rows = d.mapInArrow(run, "file string, traces long, bytes long").collect()  # a row a file
    return df.sparkSession.createDataFrame(rows, "file string, traces long, bytes long")
