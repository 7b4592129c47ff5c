"""CSV tables beside the survey files: navigation, statics, tides, misties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import coordinate_text, line_of_file
from ..functions.units import scale_coordinate

SCHEMAS = {
    "nav": "tracl int, tracr int, fldr int, x double, y double",
    "sta": "tracl int, tracr int, fldr int, static_samples double, static_ms double, swdep_m double",
    "tid": "tracl int, tracr int, fldr int, time string, tide_m double, tide_ms double, tide_samples int",
    "mst": "tracl int, tracr int, fldr int, mistie_samples int, mistie_ms double",
}


def read_auxiliary(spark: SparkSession, path: str, suffix: str, prefix: str = "", text: str = "", splitter: str = "UTM") -> DataFrame:
    """All files {prefix}*{text}.{suffix} under the path as one table; line comes from the file's name."""
    reader = spark.read.option("pathGlobFilter", f"{prefix}*{text}.{suffix}").csv(path, schema=SCHEMAS[suffix], header=True)
    return reader.withColumn("line", line_of_file(F.input_file_name(), splitter))


def navigation(traces: DataFrame, x: str = "sx", y: str = "sy", splitter: str = "UTM") -> DataFrame:
    """line, tracl, x, y of SEG-Y rows, scaled by their own scalar and unit."""
    units = F.when(F.col("counit") == 0, 1).otherwise(F.col("counit"))
    return traces.select(line_of_file(F.col("file"), splitter).alias("line"), "tracl", scale_coordinate(F.col(x), F.col("scalco"), units).alias("x"), scale_coordinate(F.col(y), F.col("scalco"), units).alias("y"))


def export_coordinates(df: DataFrame, path: str, units: int = 1, columns: list[str] | None = None) -> None:
    """CSV files of coordinates as text, by line."""
    names = ("x", "y") if units == 1 else ("lat", "lon")
    first, second = ("x", "y") if units == 1 else ("y", "x")
    df.select("line", *(columns or []), coordinate_text(F.col(first), units).alias(names[0]), coordinate_text(F.col(second), units).alias(names[1])).write.partitionBy("line").csv(path, header=True)


def wkt(x, y):
    """Point as well-known text."""
    return F.format_string("POINT (%.3f %.3f)", x.cast("double"), y.cast("double"))


def intersections_report(crossings: DataFrame, path: str, crs: str = "epsg:32760") -> None:
    """Parquet table of crossings with their geometry as text."""
    crossings.withColumns({"geometry": wkt(F.col("x"), F.col("y")), "crs": F.lit(crs)}).write.parquet(path)
