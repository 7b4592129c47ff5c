"""Stacking of traces into bins, fold, coverage, infill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("average", "median", "nearest", "idw")


def idw_weight(dist: Column, factor: float = 1.0, least: float = 1e-9) -> Column:
    """1 / d ** factor; a distance of 0 counts as `least`, so the weights of a bin stay finite."""
    return 1 / F.pow(F.greatest(dist, F.lit(least)), F.lit(float(factor)))


def normalised_weights(df: DataFrame, factor: float = 1.0, dist: str = "dist") -> DataFrame:
    """Adds `weight`; the weights of a bin sum to one."""
    w = idw_weight(F.col(dist), factor)
    return df.withColumn("weight", w / F.sum(w).over(Window.partitionBy("il", "xl")))


def stack(df: DataFrame, method: str = "average", factor: float = 1.0, value: str = "amp", dist: str = "dist", ties: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """il, xl[, extra keys], amp, fold of rows (il, xl[, extra], value, dist).

    fold counts all rows of the bin for every method. nearest takes the row of
    least distance, ties by the given columns. average and idw combine before
    the shuffle.
    """
    keys = ["il", "xl", *(extra or [])]
    if method == "average":
        amp = F.avg(value)
    elif method == "median":
        amp = F.percentile(value, 0.5)
    elif method == "nearest":
        amp = F.min_by(value, F.struct(dist, *(ties or [])))
    elif method == "idw":
        w = idw_weight(F.col(dist), factor)
        amp = F.sum(F.col(value) * w) / F.sum(w)
    else:
        raise ValueError(f"stacking method {method!r} is none of {', '.join(METHODS)}")
    return df.groupBy(*keys).agg(amp.alias("amp"), F.count("*").cast("int").alias("fold"))


def infill(bins: DataFrame, stacked: DataFrame) -> DataFrame:
    """Every bin, those without traces with amplitude and fold 0."""
    s = bins.join(stacked, ["il", "xl"], "left")
    return s.withColumns({"amp": F.coalesce("amp", F.lit(0.0)), "fold": F.coalesce("fold", F.lit(0))})


def stack_traces(traces: DataFrame, bins: DataFrame, n: int, method: str = "average", factor: float = 1.0) -> DataFrame:
    """Whole traces (il, xl, dist, samples) to one trace a bin, on an axis of n samples; empty bins are zero traces with fold 0.

    average and idw add traces up as arrays, first within a task; nearest takes
    one trace, ties by its samples; only the median needs the samples of a bin
    one by one.
    """
    d = traces.join(bins.select("il", "xl"), ["il", "xl"], "left_semi").select("il", "xl", "dist", "samples")
    if method in ("average", "idw"):
        cube = _summed(d, factor if method == "idw" else 0.0)
    elif method == "nearest":
        cube = d.groupBy("il", "xl").agg(F.count("*").cast("int").alias("fold"), F.min(F.struct("dist", "samples"))["samples"].alias("samples"))
    else:
        s = stack(d.select("il", "xl", "dist", F.posexplode("samples").alias("i", "amp")), method, factor, ties=["amp"], extra=["i"])
        cube = s.groupBy("il", "xl").agg(F.max("fold").alias("fold"), F.transform(F.array_sort(F.collect_list(F.struct("i", "amp"))), lambda v: v["amp"]).alias("samples"))
    full = bins.join(cube, ["il", "xl"], "left")
    return full.withColumns({"fold": F.coalesce("fold", F.lit(0)), "samples": F.coalesce("samples", F.array_repeat(F.lit(0.0), n))})


#: Bins whose sums a task holds before it sends them.
HELD_BINS = 20_000


def _summed(d: DataFrame, factor: float) -> DataFrame:
    """il, xl, fold, samples: means weighted by distance ** -factor, added up in each task and once more behind the shuffle."""
    parts = "il int, xl int, fold int, weight double, total binary"

    def rows(held: dict) -> pa.RecordBatch:
        il, xl = ([k[j] for k in held] for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(il, pa.int32()), pa.array(xl, pa.int32()), pa.array([v[0] for v in held.values()], pa.int32()), pa.array([v[1] for v in held.values()], pa.float64()), pa.array([v[2].tobytes() for v in held.values()], pa.binary())], names=["il", "xl", "fold", "weight", "total"])

    def add(held: dict, key: tuple, fold: int, weight: float, total: np.ndarray) -> None:
        if key not in held:
            held[key] = [fold, weight, total.copy()]
            return
        v = held[key]
        if len(total) > len(v[2]):
            v[2], total = total.copy(), v[2]
        v[0], v[1] = v[0] + fold, v[1] + weight
        v[2][: len(total)] += total

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            weight = 1 / np.maximum(b.column("dist").to_numpy(zero_copy_only=False).astype(float), 1e-9) ** factor
            for key, w, s in zip(zip(b.column("il").to_pylist(), b.column("xl").to_pylist(), strict=True), weight.tolist(), b.column("samples"), strict=True):
                add(held, key, 1, w, w * s.values.to_numpy(zero_copy_only=False).astype(float))
            if len(held) >= HELD_BINS:
                yield rows(held)
                held = {}
        yield rows(held)

    def behind(t: pa.Table) -> pa.Table:
        held = {}
        for f, w, s in sorted(zip(t.column("fold").to_pylist(), t.column("weight").to_pylist(), t.column("total").to_pylist(), strict=True)):
            add(held, (), f, w, np.frombuffer(s))
        fold, weight, total = held[()]
        return pa.table({"il": t.column("il")[:1], "xl": t.column("xl")[:1], "fold": pa.array([fold], pa.int32()), "samples": pa.array([total / weight], pa.list_(pa.float64()))})

    sums = d.select(F.col("il").cast("int").alias("il"), F.col("xl").cast("int").alias("xl"), F.col("dist").cast("double").alias("dist"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(within, parts)
    return sums.groupBy("il", "xl").applyInArrow(behind, "il int, xl int, fold int, samples array<double>")


def mask(fold: Column) -> Column:
    """1 where there is data, else 0."""
    return F.least(fold, F.lit(1))


def coverage(cube: DataFrame, fold: str = "fold") -> DataFrame:
    """n_bins, n_filled, percent (two decimals) of bins with data."""
    filled = F.sum(F.when(F.col(fold) > 0, 1).otherwise(0))
    return cube.agg(F.count("*").alias("n_bins"), filled.alias("n_filled"), F.round(filled * 100.0 / F.count("*"), 2).alias("percent"))


def check_sampling(df: DataFrame, line: str = "line", dt: str = "dt") -> DataFrame:
    """dt and n_lines of each least interval of a line: one row if the survey is sampled alike."""
    return df.groupBy(line).agg(F.min(dt).alias("dt")).groupBy("dt").agg(F.count("*").alias("n_lines"))


def sampling_interval(df: DataFrame, line: str = "line", dt: str = "dt") -> float:
    found = check_sampling(df, line, dt).limit(2).collect()
    if len(found) != 1:
        raise ValueError("sampling intervals differ between lines" if found else "no lines")
    return float(found[0]["dt"])


def time_axis(start: Column, end: Column, dt: Column) -> Column:
    """start, start + dt, ... below end, to five decimals."""
    n = F.ceil(F.round((end - start) / dt, 9)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(start + i * dt, 5))


def header_differences(headers: DataFrame) -> DataFrame:
    """key, n_values of (file, key, value) rows: keys whose value differs between files."""
    return headers.groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
