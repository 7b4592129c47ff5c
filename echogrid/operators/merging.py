"""Merging of short survey files: which to join, what to drop, how to fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import over


def files_to_merge(files: DataFrame, name: str = "file", size: str = "size", max_bytes: int = 2_000_000, group: str | None = None) -> DataFrame:
    """island, files: runs of neighbouring short files in the order of names, each with the neighbour it is joined to.

    A run takes the file after it, or the one before if there is none.
    """
    keys = [group] if group else []
    w = Window.partitionBy(*keys).orderBy(name)
    d = files.withColumns({"row": F.row_number().over(w), "small": F.col(size) < max_bytes})
    gap = F.when(F.col("small") & ~F.coalesce(F.lag("small").over(w), F.lit(False)), 1).otherwise(0)
    d = d.withColumn("island", F.sum(gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("after", F.coalesce(F.lag("small").over(w), F.lit(False)) & ~F.col("small"))
    runs = d.where(F.col("small") | F.col("after"))
    g = runs.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(name)).alias("files"), F.min(F.when(F.col("small"), F.col("row"))).alias("first"), F.max(F.when(~F.col("small"), 1).otherwise(0)).alias("has_next"))
    before = d.select(*keys, (F.col("row") + 1).alias("first"), F.col(name).alias("before"))
    g = g.join(before, [*keys, "first"], "left")
    return g.select(*keys, "island", F.when((F.col("has_next") == 0) & F.col("before").isNotNull(), F.concat(F.array("before"), "files")).otherwise(F.col("files")).alias("files"))


def choose_neighbour(before_gap, after_gap):
    """previous if it is strictly nearer, else next."""
    return F.when(before_gap < after_gap, "previous").otherwise("next")


def drop_duplicates(traces: DataFrame, line: str, seq: str, file_seq: str, columns: list[str]) -> DataFrame:
    """Of rows alike in line and columns, whatever their place in the file, the one with the least file_seq; seq is one of the columns."""
    w = Window.partitionBy(line, *columns).orderBy(file_seq)
    return traces.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


def renumbered(traces: DataFrame, line: str, seq: str, name: str = "tracr") -> DataFrame:
    """Adds 1..n in the order of seq."""
    return traces.withColumn(name, F.row_number().over(over([line], [seq])))


def merged(traces: DataFrame, line: str = "line", seq: str = "tracl", file_seq: str = "tracr", headers: list[str] | None = None, samples: str = "samples") -> DataFrame:
    """One gapless line: duplicates dropped, missing traces put in with interpolated headers and zero samples, renumbered."""
    from .windows import gap_fill

    headers = headers or []
    d = drop_duplicates(traces, line, seq, file_seq, [seq, *headers])
    d = d.dropDuplicates([line, seq])
    filled = gap_fill(d.select(line, seq, *headers), [line], seq, headers)
    n = d.groupBy(line).agg(F.max(F.size(samples)).alias("n_samples"))
    j = filled.join(n, line).join(d.select(line, seq, samples), [line, seq], "left")
    j = j.withColumn(samples, F.coalesce(F.col(samples), F.array_repeat(F.lit(0.0), F.col("n_samples")))).drop("n_samples")
    return renumbered(j, line, seq, file_seq)


def same_headers(headers: DataFrame) -> bool:
    """Whether (file, key, value) rows agree for every key; files that differ are not merged."""
    from .binning import header_differences

    return header_differences(headers).limit(1).count() == 0
