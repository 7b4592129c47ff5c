"""Delay recording times: padding to a common axis, changes within a line, their correction; static and tide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amplitudes import padded
from .windows import change_points, over, whole


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows (here: of a few numbers each)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pad_delays(traces: DataFrame, line: str = "line", delrt: str = "delrt", dt: str = "dt", samples: str = "samples") -> DataFrame:
    """Zeros before and behind each trace, so that all of a line start at its least delay; adds n_before and the new delay.

    Only two numbers a line are aggregated; the samples stay where they are.
    """
    ends = small(traces.groupBy(F.col(line).alias("end_line")).agg(F.min(delrt).alias("delrt_min"), F.max(delrt).alias("delrt_max")))
    d = traces.join(ends, F.col(line).eqNullSafe(F.col("end_line")))
    before = F.rint((F.col(delrt) - F.col("delrt_min")) / F.col(dt)).cast("int")
    after = F.rint((F.col("delrt_max") - F.col(delrt)) / F.col(dt)).cast("int")
    d = d.withColumns({"n_before": before, "n_after": after})
    return d.withColumns({samples: padded(F.col(samples), F.col("n_before"), F.col("n_after")), delrt: F.col("delrt_min")}).drop("n_after", "delrt_min", "delrt_max", "end_line")


def varying_delays(traces: DataFrame, line: str = "line", delrt: str = "delrt") -> DataFrame:
    """line, n_delays, varies."""
    return traces.groupBy(line).agg(F.count_distinct(delrt).alias("n_delays")).withColumn("varies", F.col("n_delays") > 1)


def delay_offset(picks: DataFrame, line: str = "line", delrt: str = "delrt", dt: str = "dt", pick: str = "pick") -> DataFrame:
    """Picks counted on the padded axis: plus (delay - least delay) / dt."""
    shift = F.rint((F.col(delrt) - F.min(delrt).over(whole([line]))) / F.col(dt)).cast("int")
    return picks.withColumn(pick, F.col(pick) + shift)


def correct_delays(traces: DataFrame, line: str = "line", order: str = "tracl", delrt: str = "delrt", samples: str = "samples", n_traces: int = 5, n_samples: int = 120, limit: float = 0.8) -> DataFrame:
    """line, order, delrt_new for the traces at which the delay changes and whose header is one trace off.

    For such a trace the peaks of its neighbours on both sides, in a window
    around its own peak, tell with which side it belongs. If they agree with
    the other delay, that one is given to it. Changes near the ends, among more
    than two delays, or with an unclear picture stay.
    """
    w = over([line], [order], -n_traces, n_traces)
    # changes are found on headers; only their neighbours' samples are fetched
    heads = change_points(traces.select(line, order, delrt), [line], [order], delrt)
    heads = heads.withColumns({"near": F.collect_list(F.struct(F.col(order).alias("o"), F.col(delrt).alias("delay"))).over(w), "row": F.row_number().over(over([line], [order]))})
    changed = heads.where(F.col("changed") & (F.size("near") == 2 * n_traces + 1) & (F.col("row") > n_traces))
    wanted = small(changed.select(F.col(line).alias("c_line"), F.col(order).alias("c_order"), F.col(delrt).alias("c_delay"), F.posexplode("near").alias("place", "n")))
    data = traces.select(F.col(line).alias("t_line"), F.col(order).alias("t_order"), F.transform(samples, F.abs).alias("s"))
    met = data.join(wanted, (F.col("t_line") == F.col("c_line")) & (F.col("t_order") == F.col("n.o")))
    c = met.groupBy(F.col("c_line").alias(line), F.col("c_order").alias(order), F.col("c_delay").alias(delrt)).agg(F.array_sort(F.collect_list(F.struct("place", F.col("n.delay").alias("delay"), "s"))).alias("around"))
    c = c.withColumn("a", F.get("around", F.lit(n_traces))["s"])
    c = c.withColumn("peak", F.array_position("a", F.array_max("a")).cast("int") - 1)
    top = F.array_max("a")
    best = lambda x: F.least(top, F.array_max(F.slice(x["s"], F.greatest(F.col("peak") - n_samples // 2, F.lit(0)) + 1, F.lit(n_samples))))
    c = c.withColumn("differs", F.transform("around", lambda x: F.when((top - best(x)) / F.nullif(top, F.lit(0.0)) > limit, 1).otherwise(0)))
    delays = F.array_distinct(F.transform("around", lambda x: x["delay"]))
    left, right = F.slice("differs", 1, n_traces), F.slice("differs", n_traces + 2, n_traces)
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    other = F.filter(delays, lambda x: x != F.col(delrt))[0]
    c = c.withColumns({"n_delays": F.size(delays), "l": total(left), "r": total(right), "other": other})
    # like the left side, although the header has the right side's delay
    belongs_left = (F.col("l") == 0) & (F.col("r") == n_traces)
    return c.where((F.col("n_delays") == 2) & belongs_left).select(line, order, F.col("other").alias("delrt_new"))


def swdep_scaled(df: DataFrame, line: str = "line", depth: str = "swdep", scalar: str = "scalel") -> DataFrame:
    """Water depths of headers in m: divided by the scalar where all of a line are negative, times it where all are positive, else as they are."""
    w = whole([line])
    lo, hi = F.min(scalar).over(w), F.max(scalar).over(w)
    return df.withColumn(depth, F.when(lo > 0, F.col(depth) * F.col(scalar)).when(hi < 0, F.col(depth) / F.abs(F.col(scalar))).otherwise(F.col(depth)).cast("double"))


def static_header(df: DataFrame, static: str, dt: str) -> DataFrame:
    """static_ms in thousandths as an integer header, with its scalar."""
    return df.withColumns({"static_header": F.rint(F.col(static) * F.col(dt) * 1000).cast("int"), "static_scalar": F.lit(-1000)})


def timestamp(year: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """From year, day of the year, hour, minute and second."""
    start = F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(start) + (day - 1) * 86400 + hour * 3600 + minute * 60 + second)


def at_distinct(df: DataFrame, keys: list[str], first: Column, compute) -> DataFrame:
    """compute() on one row for each distinct place, with the first time there, joined back to all rows."""
    distinct = df.groupBy(*keys).agg(F.min(first).alias("time"))
    return df.join(compute(distinct).drop("time"), keys)


#: Degrees an hour of the main tidal constituents (fixed values).
SPEEDS = {"m2": 28.9841042, "s2": 30.0, "n2": 28.4397295, "k2": 30.0821373, "k1": 15.0410686, "o1": 13.9430356, "p1": 14.9589314, "q1": 13.3986609, "m4": 57.9682084, "mf": 1.0980331, "2n2": 27.8953548, "mm": 0.5443747, "mn4": 57.4238337, "ms4": 58.9841042}


def harmonic_tide(time: Column, constituents: dict[str, tuple[float, float]]) -> Column:
    """Sum of amplitude * cos(speed * hours since 1970 - phase), phases in degrees: the provider to use where no tide model is at hand."""
    hours = F.unix_timestamp(time) / F.lit(3600.0)
    out = F.lit(0.0)
    for name, (amplitude, phase) in sorted(constituents.items()):
        out = out + F.lit(float(amplitude)) * F.cos(F.radians(F.pmod(hours * SPEEDS[name], F.lit(360.0)) - F.lit(float(phase))))
    return out


def depressions(df: DataFrame, line: str, order: str, flag: Column, least: int = 3) -> DataFrame:
    """Runs of at least so many flagged traces."""
    from .windows import islands

    return islands(df, [line], order, flag).where(F.col("n") >= least)


def limited(static: Column, samples: float | None = None, percentile: Column | None = None) -> Column:
    """Statics clipped to +- samples and to +- a percentile of their size."""
    out = static
    for bound in (percentile, None if samples is None else F.lit(float(samples))):
        if bound is not None:
            out = F.greatest(-bound, F.least(bound, out))
    return out


def lowpass_static(df: DataFrame, line: str, order: str, pick: str, win: int = 7) -> DataFrame:
    """Adds `lowpass` and `static` = lowpass - pick. A Savitzky-Golay filter of order 1 is a centred mean; at the ends, the line fitted to the outermost window."""
    h = win // 2
    w = over([line], [order], -h, h)
    d = df.withColumns({"row": F.row_number().over(over([line], [order])), "n": F.count("*").over(whole([line]))})
    inner = F.avg(pick).over(w)
    window = Window.partitionBy(line)
    fit = lambda lo, hi: (F.regr_slope(F.when((F.col("row") >= lo) & (F.col("row") <= hi), F.col(pick)), F.col("row")).over(window), F.regr_intercept(F.when((F.col("row") >= lo) & (F.col("row") <= hi), F.col(pick)), F.col("row")).over(window))
    (s0, i0), (s1, i1) = fit(F.lit(1), F.lit(win)), fit(F.col("n") - win + 1, F.col("n"))
    low = F.when(F.col("n") < win, F.col(pick).cast("double")).when(F.col("row") <= h, s0 * F.col("row") + i0).when(F.col("row") > F.col("n") - h, s1 * F.col("row") + i1).otherwise(inner)
    d = d.withColumn("lowpass", low)
    return d.withColumn("static", F.col("lowpass") - F.col(pick)).drop("row", "n")
