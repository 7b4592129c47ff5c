"""Tables that cut the lineage of loops, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[str] = []


def _clean() -> None:
    """Delete the tables of this application that are left when it ends, where a file system is at hand."""
    for path in _tables:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(_clean)


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a cluster must name one. On a local master, where it is unset, a temporary one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        made = tempfile.mkdtemp(prefix="echogrid-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table that is written and read again: what follows starts from there after the loss of an executor."""
    path = f"{folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loop_path = path
    if path.startswith("file:"):
        _tables.append(path)
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of written(); no result may need it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._loop_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
