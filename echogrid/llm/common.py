"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir, and must: a folder of one machine
    is no shared folder. Where it is unset on a local master (a single machine,
    tests), a temporary folder is made and set once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        folder = tempfile.mkdtemp(prefix="echogrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_staged: list[str] = []


def _clean() -> None:
    """Delete the tables that are left when the application ends: no result can be read then."""
    for path in _staged:
        try:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif (spark := SparkSession.getActiveSession()) is not None:
                _delete(spark, path)
        except Exception as e:  # noqa: BLE001  a store that is gone must not spoil the end of the program
            print(f"left behind: {path} ({e})", file=sys.stderr)


atexit.register(_clean)


def stage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: what follows can be recomputed after the loss of an
    executor without running what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the table that stage() returned as df; what reads it must have been written."""
    files = df.inputFiles()
    path = files[0].rpartition("/")[0] if files else ""
    if path.rpartition("/")[2] in {p.rpartition("/")[2] for p in _staged}:
        _staged[:] = [p for p in _staged if p.rpartition("/")[2] != path.rpartition("/")[2]]
        _delete(df.sparkSession, path)


def drop_stages(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables that stage() has written so far, from number `since` on, but for the one that it returned as `keep`.

    Results that read them must have been written.
    """
    files = keep.inputFiles() if keep is not None else []
    kept = files[0].rpartition("/")[0].rpartition("/")[2] if files else ""
    for path in _staged[since:]:
        if path.rpartition("/")[2] != kept:
            _staged.remove(path)
            _delete(spark, path)


def n_staged() -> int:
    """How many tables stage() has written that still are there; drop_stages() takes it as `since`."""
    return len(_staged)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended.

    It does so when the driver's objects for them are collected, which a large
    heap puts off while disks fill up. Called between phases that each shuffle
    about as much as the input. The last job's plan is still known to Spark's
    listeners, so a small one is run after it.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: high bytes that are zero are left to compression."""
    return np.ascontiguousarray(np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row, however often a lambda in the body asks for it."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, merge: Callable[[Column, Column], Column], zero: Column, levels: int = 3) -> Column:
    """For each element of an array, what merge makes of those before it, from zero on.

    Blocks of 16, and blocks of their results in turn, so the work grows with
    the length and not with its square; appending to an array in a fold copies
    it at every step.
    """
    both = lambda x, y: merge(x, y)  # noqa: E731  Spark counts the arguments
    so_far = lambda a, i: F.aggregate(F.slice(a, F.lit(1), i), zero, both)
    if not levels:
        return let(values, lambda a: F.transform(a, lambda x, i: so_far(a, i)))
    cut = lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 16)), lambda k: F.slice(a, (k * 16 + 1).cast("int"), F.lit(16)))).otherwise(F.slice(F.array(a), 1, 0))
    return let(
        let(values, cut),
        lambda blocks: let(
            before(F.transform(blocks, lambda b: F.aggregate(b, zero, both)), merge, zero, levels - 1),
            lambda offsets: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x, i: merge(F.get(offsets, k), so_far(b, i))))),
        ),
    )


CHUNK = 512


def chunks(text: Column) -> Column:
    """A text as an array of CHUNK characters each, found in two steps; see part()."""
    cut = lambda t, n: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / n)), lambda k: F.substring(t, (k * n + 1).cast("int"), F.lit(n)))).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(cut(text, CHUNK * CHUNK), lambda t: cut(t, CHUNK)))


def part(chunked: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in chunks(): a substring() of the whole walks through all before it."""
    first = F.floor(start / CHUNK)
    few = F.slice(chunked, (first + 1).cast("int"), (F.floor(end / CHUNK) - first + 1).cast("int"))
    return F.substring(F.array_join(few, ""), (start % CHUNK + 1).cast("int"), (end - start).cast("int"))


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df as one struct column `row`, beside the named columns.

    Operators work on this form, so that no column of the input can clash with
    a working column.
    """
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def restored(df: DataFrame, *outputs: str, replace: dict[str, Column] | None = None) -> DataFrame:
    """Undo carried(): the input's columns, then the outputs.

    An output replaces an input column of the same name; `replace` gives new
    values for input columns and keeps their place.
    """
    replace = replace or {}
    own = [f.name for f in df.schema["row"].dataType.fields]
    keep = [replace[c].alias(c) if c in replace else F.col("row").getField(c).alias(c) for c in own if c not in outputs]
    return df.select(*keep, *[F.col(c) for c in outputs])


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, which is evaluated where it stands.

    Spark would push it below the columns that it is made of, and compute each
    of them again for every use inside it. A column that isn't deterministic
    keeps it in place.
    """
    at = "fence_" + uuid.uuid4().hex
    return df.withColumn(at, F.monotonically_increasing_id()).where(condition & (F.col(at) >= 0)).drop(at)
