"""Moving windows along lines or samples, change points, islands, gap filling.

Windows are Spark window frames over (keys, order); a frame's rows come from
one sort, and no row sees more of its key than the frame. The functions take
the DataFrame, the keys that bound a line, and a total order in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: Sequence[str], order: Sequence[str], *frame: int | None):
    """The window of a line; with a frame (lo, hi) in rows, None for unbounded."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not frame:
        return w
    lo, hi = frame
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


def whole(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def moving_windows(df: DataFrame, keys, order, value: str, win: int, step: int = 1) -> DataFrame:
    """keys, order, window: every full window of `win` values, one each `step` rows from the first."""
    d = df.withColumns({"window": F.collect_list(value).over(over(keys, order, 0, win - 1)), "row": F.row_number().over(over(keys, order)) - 1})
    return d.where((F.size("window") == win) & (F.col("row") % step == 0)).select(*keys, *order, "window")


def moving_average(df: DataFrame, keys, order, value: str, win: int = 3) -> DataFrame:
    """Adds `mean` of the window that starts at the row; only full windows stay."""
    w = over(keys, order, 0, win - 1)
    return df.withColumns({"mean": F.avg(value).over(w), "in_window": F.count("*").over(w)}).where(F.col("in_window") == win).drop("in_window")


def moving_median(df: DataFrame, keys, order, value: str, win: int = 3) -> DataFrame:
    """Adds `median` of the centred window; only full windows stay."""
    h = win // 2
    w = over(keys, order, -h, h)
    return df.withColumns({"median": F.percentile(value, 0.5).over(w), "in_window": F.count("*").over(w)}).where(F.col("in_window") == 2 * h + 1).drop("in_window")


def moving_median_mirrored(df: DataFrame, keys, order, value: str, win: int = 3) -> DataFrame:
    """Adds `median` of the centred window on data that is mirrored at both ends (end - |x - end|)."""
    h = win // 2
    d = df.withColumns({"row": F.row_number().over(over(keys, order)), "n": F.count("*").over(whole(keys)), "v0": F.first(value).over(over(keys, order, None, None)), "v1": F.last(value).over(over(keys, order, None, None))})
    k = [*keys, F.col(value).alias("v")]
    inner = d.select(*k, "row", F.lit(True).alias("own"), *[c for c in order])
    mirror = lambda cond, row, end: d.where(cond).select(*keys, (F.col(end) - F.abs(F.col(value) - F.col(end))).alias("v"), row.alias("row"), F.lit(False).alias("own"), *order)
    left = mirror((F.col("row") > 1) & (F.col("row") <= h + 1), 2 - F.col("row"), "v0")
    right = mirror((F.col("row") < F.col("n")) & (F.col("row") >= F.col("n") - h), 2 * F.col("n") - F.col("row"), "v1")
    m = inner.unionByName(left).unionByName(right).withColumn("median", F.percentile("v", 0.5).over(over(keys, ["row"], -h, h)))
    return m.where("own").select(*keys, *order, F.col("v").alias(value), "median")


def sta_lta(df: DataFrame, keys, order, value: str, nsta: int, nlta: int) -> DataFrame:
    """Adds `ratio` of the trailing means of squares over nsta and nlta rows; 0 for the first nlta - 1 rows and where the longer mean is 0."""
    sq = F.col(value) * F.col(value)
    sta = F.sum(sq).over(over(keys, order, -(nsta - 1), 0)) / nsta
    lta = F.sum(sq).over(over(keys, order, -(nlta - 1), 0)) / nlta
    row = F.row_number().over(over(keys, order))
    return df.withColumn("ratio", F.when((row < nlta) | (lta == 0), 0.0).otherwise(sta / F.nullif(lta, F.lit(0.0))))


def agc_long(df: DataFrame, keys, order, value: str, win: int, kind: str = "rms", squared: bool = False) -> DataFrame:
    """Adds `gain` and `agc` over sample rows: the gain of functions.amplitudes.agc as window frames."""
    w, x = over(keys, order, -(win // 2), win // 2), F.col(value)
    if kind == "median":
        # zeros beyond the ends are part of the window
        g = F.transform(F.array(F.concat(F.collect_list(value).over(w), F.array_repeat(F.lit(0.0), (F.lit(win) - F.count("*").over(w)).cast("int")))), lambda a: F.array_sort(a)[win // 2])[0]
    else:
        g = F.sum(x * x if kind == "rms" else x).over(w) / win
        g = F.sqrt(g) if kind == "rms" else g
    d = df.withColumn("gain", F.when(g == 0, 1.0).otherwise(g))
    y = x / F.col("gain")
    return d.withColumn("agc", F.signum(y) * y * y if squared else y)


def balance_windowed(df: DataFrame, line: str, tracl: str, sample: str, value: str, n_traces: int, scale: str = "rms") -> DataFrame:
    """Adds `reference` and `balanced`: rms or mean of absolute amplitudes over a centred window of traces, those beyond the ends counting as zeros.

    Each trace is first summed to one number; only those go through the window.
    """
    x = F.col(value)
    part = F.sum(x * x if scale == "rms" else F.abs(x))
    t = df.groupBy(line, tracl).agg(part.alias("part"), F.count("*").alias("ns"))
    h = n_traces // 2
    ref = F.sum("part").over(over([line], [tracl], -h, h)) / (n_traces * F.col("ns"))
    t = t.withColumn("reference", F.sqrt(ref) if scale == "rms" else ref)
    t = t.select(line, tracl, F.when(F.col("reference") == 0, 1.0).otherwise(F.col("reference")).alias("reference"))
    return df.join(t, [line, tracl]).withColumn("balanced", x / F.col("reference"))


def moving_window_2d(df: DataFrame, line: str, tracl: str, sample: str, value: str, n_samples: int, reach: int) -> DataFrame:
    """line, tracl, win, mean: the mean absolute amplitude of each block of n_samples over the traces whose number is within `reach`.

    A block of a trace is first one sum; only those go through the frame.
    """
    d = df.withColumn("win", F.floor(F.col(sample) / n_samples).cast("int"))
    part = d.groupBy(line, "win", tracl).agg(F.sum(F.abs(value)).alias("e"), F.count("*").alias("n"))
    w = Window.partitionBy(line, "win").orderBy(tracl).rangeBetween(-reach, reach)
    return part.select(line, tracl, "win", (F.sum("e").over(w) / F.sum("n").over(w)).alias("mean"))


def change_points(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Adds `changed`, true where the value differs from the row before (false for the first)."""
    before = F.lag(value).over(over(keys, order))
    row = F.row_number().over(over(keys, order))
    return df.withColumn("changed", (row > 1) & ~F.col(value).eqNullSafe(before))


def segments(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Adds `segment`: the number, from 0, of the run of equal values that the row is in."""
    d = change_points(df, keys, order, value)
    return d.withColumn("segment", F.sum(F.col("changed").cast("int")).over(over(keys, order, None, 0))).drop("changed")


def islands(df: DataFrame, keys, order: str, flag: Column) -> DataFrame:
    """keys, island, first, last, n: runs of consecutive numbers `order` among the rows with the flag."""
    d = df.where(flag)
    gap = F.col(order) - F.lag(order).over(over(keys, [order]))
    d = d.withColumn("new", F.when(gap == 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(over(keys, [order], None, 0)))
    return d.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def gap_fill(df: DataFrame, keys, order: str, values: Sequence[str]) -> DataFrame:
    """A row for every number between the least and the largest of its key; `filled` marks new ones.

    Values of new rows are interpolated linearly between their neighbours and
    truncated to whole numbers if the column is integral. Numbers must be
    unique in their key.
    """
    ends = df.groupBy(*keys).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    every = ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias(order))
    d = every.join(df.select(*keys, order, *values, F.lit(False).alias("filled")), [*keys, order], "left").withColumn("filled", F.coalesce("filled", F.lit(True)))
    back, ahead = over(keys, [order], None, 0), over(keys, [order], 0, None)
    at = F.when(~F.col("filled"), F.col(order))
    a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    out = {}
    for v in values:
        x, y = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
        new = x + (y - x) * (F.col(order) - a) / (b - a)
        out[v] = F.when(F.col("filled"), new).otherwise(F.col(v)).cast(df.schema[v].dataType)
    return d.withColumns(out)
