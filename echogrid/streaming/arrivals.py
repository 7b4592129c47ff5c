"""New trace tables that are dropped into a folder, folded into the bins' sums as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry


def traces(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet trace files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_fold(stream: DataFrame, transform: geometry.Affine, value: str = "amp") -> DataFrame:
    """il, xl, fold, amp (mean) of all that has arrived; state is one row a bin."""
    b = geometry.trace_bins(stream, transform)
    return b.groupBy("il", "xl").agg(F.count("*").alias("fold"), F.avg(value).alias("amp"))


def arrivals_per_window(stream: DataFrame, time: str = "time", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """line, window, n: traces of each line in tumbling windows; what comes later than `late` is left out."""
    return stream.withWatermark(time, late).groupBy("line", F.window(time, window)).agg(F.count("*").alias("n"))
