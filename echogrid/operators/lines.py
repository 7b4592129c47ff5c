"""Operators that need a whole line at once: picking, statics, despiking, misties between lines.

A line is the unit of work (some thousand traces); lines are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from ..kernels import dsp, picking


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("tracl", kind="stable").reset_index(drop=True)
    n = max((len(s) for s in pdf["samples"]), default=0)
    data = np.zeros((len(pdf), n))
    for i, s in enumerate(pdf["samples"]):
        data[i, : len(s)] = s
    return pdf, data


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def pick_seafloor(traces: DataFrame, **options) -> DataFrame:
    """line, tracl, pick."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, data = _sorted(pdf)
        return pd.DataFrame({"line": pdf["line"], "tracl": pdf["tracl"], "pick": picking.seafloor(data, **options)})

    return traces.select("line", "tracl", "samples").groupBy("line").applyInPandas(run, f"line {_kind(traces, 'line')}, tracl {_kind(traces, 'tracl')}, pick long")


def statics(picks: DataFrame, **options) -> DataFrame:
    """line, tracl, pick, static of picks (line, tracl, pick)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tracl", kind="stable").reset_index(drop=True)
        return pdf.assign(static=picking.static(pdf["pick"].to_numpy(float), **options))[["line", "tracl", "pick", "static"]]

    return picks.select("line", "tracl", "pick").groupBy("line").applyInPandas(run, f"line {_kind(picks, 'line')}, tracl {_kind(picks, 'tracl')}, pick {_kind(picks, 'pick')}, static double")


def despike(traces: DataFrame, segment: str | None = None, **options) -> DataFrame:
    """line, tracl, samples, n_replaced; with `segment`, its runs (of equal delay) are edited apart."""
    keys = ["line", *([segment] if segment else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, data = _sorted(pdf)
        edited, found = picking.despike(data, **options)
        n = np.zeros(len(pdf), np.int64)
        for c, lo, hi in found:
            n[c] += hi - lo + 1
        return pd.DataFrame({"line": pdf["line"], "tracl": pdf["tracl"], "samples": list(edited), "n_replaced": n})

    d = traces.select(*dict.fromkeys([*keys, "tracl", "samples"]))
    return d.groupBy(*keys).applyInPandas(run, f"line {_kind(traces, 'line')}, tracl {_kind(traces, 'tracl')}, samples array<double>, n_replaced long")


def bad_traces_mixed(traces: DataFrame, n: int = 3, limit: float = 0.4) -> DataFrame:
    """Traces whose mean, rescaled to 0..1, is above the limit get the mean of their neighbours in a window of n instead."""
    lo, hi = F.array_min("samples"), F.array_max("samples")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    d = traces.withColumn("bad", F.coalesce((mean - lo) / F.nullif(hi - lo, F.lit(0.0)) > limit, F.lit(False)))
    h = n // 2
    bad = d.where("bad").select("line", "tracl")
    around = bad.select("line", F.col("tracl").alias("own"), F.explode(F.array(*[F.col("tracl") + k for k in range(-h, h + 1) if k])).alias("tracl"))
    s = around.join(traces.select("line", "tracl", "samples"), ["line", "tracl"]).select("line", F.col("own").alias("tracl"), F.posexplode("samples").alias("i", "v"))
    m = s.groupBy("line", "tracl", "i").agg(F.avg("v").alias("v")).groupBy("line", "tracl").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mixed"))
    return d.join(m, ["line", "tracl"], "left").withColumn("samples", F.coalesce("mixed", "samples")).drop("mixed", "bad")


def correlate(pairs: DataFrame, a: str = "samples_a", b: str = "samples_b") -> DataFrame:
    """Adds lag (samples) and r of the envelopes of two traces, where neither is zero."""

    @F.pandas_udf("struct<lag:int,r:double>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            n = min(len(p), len(q))
            p, q = dsp.envelope(np.asarray(p[:n], float)), dsp.envelope(np.asarray(q[:n], float))
            ok = (p != 0) & (q != 0)
            p, q = p[ok], q[ok]
            if len(p) < 2 or p.std() == 0 or q.std() == 0:
                out.append((0, 0.0))
                continue
            out.append((dsp.lag(dsp.cross_correlation(p, q)), float(np.corrcoef(p, q)[0, 1])))
        return pd.DataFrame(out, columns=["lag", "r"])

    return pairs.withColumn("cc", run(F.col(a), F.col(b))).select("*", F.col("cc.lag").alias("lag"), F.col("cc.r").alias("r")).drop("cc")


def solved_shifts(pairs: DataFrame, quality: float = 0.5, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """line, offset, n, rms: the shift of each line that fits the lags of its crossings best, their number and the root mean square of what is left.

    The least-norm solution of shift_a - shift_b = lag over the crossings
    (line_a, line_b, lag, r) with |r| of at least the quality, by conjugate
    gradients on the normal equations. Those are a sparse matrix, a row an edge
    of the network of lines; a step is a join of edges with lines and a sum a
    line, and is written. The driver sees two sums a step. Started from zero,
    the mean of every connected network's shifts stays zero: one gauge each.
    Crossings of a line with itself, or without lag, say nothing and don't
    count. At most `most` steps; lines are met in as many at the latest.
    """
    d = pairs.where((F.abs("r") >= quality) & F.col("lag").isNotNull() & (F.col("line_a") != F.col("line_b")))
    edges = written(d.groupBy("line_a", "line_b").agg(F.count("*").alias("n"), F.sum("lag").cast("double").alias("lag"), F.sum(F.col("lag") * F.col("lag")).cast("double").alias("lag2")))
    both = edges.select(F.col("line_a").alias("line"), F.col("line_b").alias("other"), "n", "lag", "lag2").unionByName(edges.select(F.col("line_b").alias("line"), F.col("line_a").alias("other"), "n", (-F.col("lag")).alias("lag"), "lag2"))
    state = written(both.groupBy("line").agg(F.sum("lag").alias("r"), F.sum("n").alias("degree")).select("line", "degree", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    energy = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    first, k = energy, 0
    while energy > tolerance**2 * first and k < most:
        k += 1
        out = both.join(state.select(F.col("line").alias("other"), F.col("p").alias("q")), "other").groupBy("line").agg(F.sum(F.col("n") * F.col("q")).alias("s"))
        step = state.join(out, "line").withColumn("ap", F.col("degree") * F.col("p") - F.col("s"))
        step = written(step)
        curve = step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0] or 0.0
        if curve <= 0:
            break
        a = energy / curve
        step = step.withColumns({"x": F.col("x") + a * F.col("p"), "r": F.col("r") - a * F.col("ap")})
        left = step.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = written(step.select("line", "degree", "x", "r", (F.col("r") + (left / energy) * F.col("p")).alias("p")))
        energy = left
    at = lambda name: state.select(F.col("line").alias(name), F.col("x").alias(f"x_{name}"))
    j = both.join(at("line"), "line").join(at("other"), "other")
    gap = F.col("x_line") - F.col("x_other")
    # over the crossings of an edge: sum (lag - gap)^2
    rest = j.groupBy("line").agg(F.sum(F.col("lag2") - 2 * gap * F.col("lag") + F.col("n") * gap * gap).alias("s"), F.sum("n").alias("n"))
    return state.join(rest, "line").select("line", F.col("x").alias("offset"), F.col("n"), F.sqrt(F.greatest(F.col("s"), F.lit(0.0)) / F.col("n")).alias("rms"))


def residuals(pairs: DataFrame, shifts: DataFrame, value: str = "offset") -> DataFrame:
    """The crossings with shift_a, shift_b and residual = lag - (shift_a - shift_b); null where a line has no shift."""
    a, b = (shifts.select(F.col("line").alias(f"line_{k}"), F.col(value).alias(f"shift_{k}")) for k in "ab")
    return pairs.join(a, "line_a", "left").join(b, "line_b", "left").withColumn("residual", F.col("lag") - (F.col("shift_a") - F.col("shift_b")))


def line_shifts(pairs: DataFrame, quality: float = 0.5) -> DataFrame:
    """line, shift: solved_shifts() in whole samples."""
    return solved_shifts(pairs, quality).select("line", F.rint("offset").cast("int").alias("shift"))
