"""Interpolation of slices by projection onto convex sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.pocs import pocs
from ..layouts import lists, per_slice

SCHEMA = "slice long, n_il int, n_xl int, grid array<double>, imag array<double>, niter int, cost double, runtime double"


def mask_of(bins: DataFrame, n_il: int, n_xl: int, fold: str = "fold") -> np.ndarray:
    """Row-major 0 or 1 of each bin of rows (il, xl, fold), a byte a bin; bins without a row are 0.

    It is one number a bin of one slice, and each slice is a value of eight
    bytes a bin already.
    """
    t = bins.where(F.col(fold) > 0).select(((F.col("il") - 1).cast("long") * n_xl + F.col("xl") - 1).alias("k")).toArrow()
    out = np.zeros(n_il * n_xl, np.uint8)
    out[t.column("k").to_numpy()] = 1
    return out


def interpolate(slices: DataFrame, mask: np.ndarray | list[int], **options) -> DataFrame:
    """Slices (slice, n_il, n_xl, grid[, imag]) with the bins of mask 0 filled; niter, cost and runtime of each.

    The mask, row-major, is the cube's fold clipped to 0 or 1: one number a
    bin, the same for all slices. Slices are independent, so there is no
    shuffle; repartition before for more parallel tasks than input partitions.
    """
    shared = slices.sparkSession.sparkContext.broadcast(np.asarray(mask, np.uint8))
    has_imag = "imag" in slices.columns
    d = slices.select("slice", "n_il", "n_xl", "grid", *(["imag"] if has_imag else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.astype(float)
        for b in batches:
            out = {n: [] for n in ("grid", "imag", "niter", "cost", "runtime")}
            for i in range(b.num_rows):
                shape = (b.column("n_il")[i].as_py(), b.column("n_xl")[i].as_py())
                x = b.column("grid")[i].values.to_numpy().reshape(shape)
                if has_imag:
                    x = x + 1j * b.column("imag")[i].values.to_numpy().reshape(shape)
                got = pocs(x, m.reshape(shape), **options)
                out["grid"].append(np.ravel(got.grid.real))
                out["imag"].append(np.ravel(got.grid.imag) if has_imag else None)
                for k in ("niter", "cost", "runtime"):
                    out[k].append(getattr(got, k))
            grids = pa.list_(pa.float64())
            kinds = {"grid": grids, "imag": grids, "niter": pa.int32(), "cost": pa.float64(), "runtime": pa.float64()}
            fixed = [b.column("slice").cast(pa.int64()), b.column("n_il").cast(pa.int32()), b.column("n_xl").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(out[k], t) for k, t in kinds.items()]], names=["slice", "n_il", "n_xl", *kinds])

    return d.mapInArrow(run, SCHEMA)


def interpolate_cube(samples: DataFrame, n_il: int, n_xl: int, mask: np.ndarray | list[int], value: str = "amp", **options) -> DataFrame:
    """interpolate() of the slices of real rows (il, xl, i, value): a slice is put together and filled in one task, which holds no other."""
    shared = samples.sparkSession.sparkContext.broadcast(np.asarray(mask, np.uint8))

    def fill(number: int, grids: list[np.ndarray]) -> pa.Table:
        got = pocs(grids.pop().reshape(n_il, n_xl), shared.value.reshape(n_il, n_xl), **options)
        fixed = {"slice": pa.array([number], pa.int64()), "n_il": pa.array([n_il], pa.int32()), "n_xl": pa.array([n_xl], pa.int32())}
        return pa.table({**fixed, "grid": lists(got.grid.real), "imag": pa.nulls(1, pa.list_(pa.float64())), "niter": pa.array([got.niter], pa.int32()), "cost": pa.array([got.cost], pa.float64()), "runtime": pa.array([got.runtime], pa.float64())})

    return per_slice(samples, n_il, n_xl, fill, SCHEMA, value)


def resume(slices: DataFrame, mask: np.ndarray | list[int], path: str, size: int = 256, **options) -> DataFrame:
    """interpolate() in batches of slice numbers, each written to path/batch=N; what earlier attempts have finished is not done again.

    A batch is finished when Spark's commit has left its mark in the folder, so
    one that was stopped half-way is written anew, and only slices of unfinished
    batches are read. The result holds all attempts' slices, with their metrics
    and the number of the attempt. `size` slices are one job: more than there
    are cores keep all of them busy.
    """
    spark = slices.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    of = F.floor(F.col("slice") / size)
    batches = [r[0] for r in slices.select(of.alias("b")).distinct().orderBy("b").collect()]  # a number a batch
    folder = lambda b: f"{path.rstrip('/')}/batch={b}"
    done = {b for b in batches if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder(b)}/_SUCCESS"))}
    attempt = 1
    if done:
        attempt += spark.read.parquet(*map(folder, sorted(done))).agg(F.max("attempt")).first()[0] or 0
    for b in batches:
        if b not in done:
            out = interpolate(slices.where(of == b), mask, **options)
            out.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(folder(b))
    if not batches:
        return interpolate(slices, mask, **options).withColumn("attempt", F.lit(attempt))
    return spark.read.option("basePath", path).parquet(*map(folder, batches)).drop("batch")


def run_metrics(result: DataFrame) -> DataFrame:
    """attempt, slices, iterations, seconds, worst_cost of each attempt in the result of resume()."""
    m = result.groupBy("attempt").agg(F.count("*").alias("slices"), F.sum("niter").alias("iterations"), F.sum("runtime").alias("seconds"), F.max("cost").alias("worst_cost"))
    return m.orderBy("attempt")
