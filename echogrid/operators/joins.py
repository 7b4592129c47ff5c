"""Nearest joins, segments, intersections of survey lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .geometry import distance


#: Vertices of a line that nearest_vertex() takes as one array at most.
SHORT = 64


def nearest_regular(x: Column, start: float, step: float, n: int) -> Column:
    """Number, from 0, of the nearest value of start, start + step, ...; halves to even, ends hold."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((x - start) / F.lit(float(step))).cast("int")))


def intervals(reference: DataFrame, value: str) -> DataFrame:
    """value, lo, hi: the half-open interval (lo, hi] of what is nearest to each distinct reference value."""
    w = Window.orderBy(value)
    d = reference.select(value).distinct()  # axes of a grid: some thousand values
    lo = (F.lag(value).over(w) + F.col(value)) / 2
    hi = (F.lead(value).over(w) + F.col(value)) / 2
    return d.select(value, F.coalesce(lo, F.lit(float("-inf"))).alias("lo"), F.coalesce(hi, F.lit(float("inf"))).alias("hi"))


def nearest_join(df: DataFrame, x: str, reference: DataFrame, value: str) -> DataFrame:
    """Adds the nearest reference value to each row; a midpoint goes to the smaller.

    Rows are dealt to their interval by a range join on a bucketed key: all
    intervals that reach into a bucket of the reference's mean step.
    """
    r = intervals(reference, value)
    lo, hi, n = reference.agg(F.min(value), F.max(value), F.count_distinct(value)).first()
    width = (hi - lo) / max(n - 1, 1) or 1.0
    bucket = lambda c: F.floor((F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)) - lo) / F.lit(float(width))).cast("int")
    r = r.withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))).withColumnRenamed(value, "nearest")
    d = df.withColumn("b", bucket(F.col(x)))
    return d.join(r, (d["b"] == r["b"]) & (F.col(x) > F.col("lo")) & (F.col(x) <= F.col("hi"))).drop(r["b"]).drop("b", "lo", "hi")


def segments(points: DataFrame, line: str = "line", order: str = "tracl", x: str = "x", y: str = "y") -> DataFrame:
    """line, seg, x0, y0, x1, y1: consecutive points of each line joined."""
    w = Window.partitionBy(line).orderBy(order)
    s = points.select(F.col(line).alias("line"), F.col(order).alias("seg"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    return s.where(F.col("x1").isNotNull())


def intersections(segs: DataFrame, cell: float) -> DataFrame:
    """line_a, line_b (a < b), seg_a, seg_b, x, y where segments of two lines cross or touch.

    Each segment goes to the grid cells of `cell` units that its box covers;
    segments meet on a cell, a pair only in the first cell that both cover, so
    it needs no distinct. Parallel segments, overlapping ones too, give no
    point. A cell should be about as long as a segment.

    What is asked of the points, here and by callers, stays out of the join:
    Spark would repeat their whole arithmetic there for each use, in a method
    too long for the JVM to compile.
    """
    c = lambda v: F.floor(v / F.lit(float(cell))).cast("long")
    lo = lambda a, b: F.least(F.col(a), F.col(b))
    hi = lambda a, b: F.greatest(F.col(a), F.col(b))
    s = segs.withColumns({"cx0": c(lo("x0", "x1")), "cx1": c(hi("x0", "x1")), "cy0": c(lo("y0", "y1")), "cy1": c(hi("y0", "y1"))})
    s = s.withColumn("cx", F.explode(F.sequence("cx0", "cx1"))).withColumn("cy", F.explode(F.sequence("cy0", "cy1")))
    a, b = s.alias("a"), s.alias("b")
    k = lambda n: F.col(n)
    first = (k("a.cx") == F.greatest(k("a.cx0"), k("b.cx0"))) & (k("a.cy") == F.greatest(k("a.cy0"), k("b.cy0")))
    j = a.join(b, (k("a.cx") == k("b.cx")) & (k("a.cy") == k("b.cy")) & (k("a.line") < k("b.line")) & first)
    dx, dy, ex, ey = k("a.x1") - k("a.x0"), k("a.y1") - k("a.y0"), k("b.x1") - k("b.x0"), k("b.y1") - k("b.y0")
    fx, fy = k("b.x0") - k("a.x0"), k("b.y0") - k("a.y0")
    # a number that isn't deterministic keeps the conditions where they stand
    d = j.select(k("a.line").alias("line_a"), k("b.line").alias("line_b"), k("a.seg").alias("seg_a"), k("b.seg").alias("seg_b"), k("a.x0"), k("a.y0"), dx.alias("dx"), dy.alias("dy"), (fx * ey - fy * ex).alias("nt"), (fx * dy - fy * dx).alias("nu"), F.nullif(dx * ey - dy * ex, F.lit(0.0)).alias("den"), F.monotonically_increasing_id().alias("here"))
    d = d.withColumns({"t": k("nt") / k("den"), "u": k("nu") / k("den")}).where("t >= 0 AND t <= 1 AND u >= 0 AND u <= 1 AND here >= 0")
    return d.select("line_a", "line_b", "seg_a", "seg_b", (k("x0") + k("t") * k("dx")).alias("x"), (k("y0") + k("t") * k("dy")).alias("y"))


def spacing(points: DataFrame, line: str = "line", order: str = "tracl", x: str = "x", y: str = "y") -> float:
    """The mean length of the segments between a line's points that differ; 1 without any."""
    s = segments(points, line, order, x, y)
    d = distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return s.select(d.alias("d")).where("d > 0").agg(F.avg("d")).first()[0] or 1.0


def nearest_vertex(points: DataFrame, targets: DataFrame, line: str, order: str = "tracl", point_line: str = "line", cell: float | None = None, digits: int | None = None) -> DataFrame:
    """Target's columns, then nearest and dist: the vertex of the target's line that is nearest, ties to the smaller number.

    With `digits`, distances that are equal when rounded to so many decimals
    are ties; dist is the smallest of them, not rounded.

    The vertices of a line of up to SHORT of them meet each of its targets, as
    an array. On longer lines, or all if `cell` is given, vertices and targets
    meet on the line and on cells, by default as large as the mean distance
    between these lines' vertices. A target looks at its own cell and the eight
    around it, which hold all vertices within a cell's side; if none is that
    near, it looks again at cells of twice the side. So a vertex meets targets
    nearby only, whatever the length of its line. Targets of lines without
    vertices, and targets or vertices without finite coordinates, give no row.
    """
    finite = lambda c: F.col(c).isNotNull() & ((F.col(c) - F.col(c)) == 0)
    v = written(points.select(F.col(point_line).alias("p_line"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.col(order).alias("p_order")).where(finite("px") & finite("py") & F.col("p_line").isNotNull()))
    asked = targets.where(finite("x") & finite("y"))
    if cell:
        return _nearest_by_cells(v, asked, line, float(cell), digits)
    long = written(v.groupBy("p_line").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select("p_line"))
    if long.isEmpty():
        return _nearest_of_all(v, asked, line, digits)
    of_long, asked = v.join(long, "p_line", "left_semi"), written(asked)
    far = _nearest_by_cells(of_long, asked, line, spacing(of_long, "p_line", "p_order", "px", "py"), digits)
    return far.unionByName(_nearest_of_all(v.join(long, "p_line", "left_anti"), asked, line, digits))


def _tied(d: Column, digits: int | None) -> Column:
    """Equal for distances that are ties: their multiples of 10^-digits, halves up. As F.round(), which writes every number as text."""
    if digits is None:
        return d
    n = d * F.lit(10.0**digits)
    return F.when(n < 2.0**52, (F.floor(n) + F.when(n - F.floor(n) >= 0.5, 1).otherwise(0)).cast("double")).otherwise(n)


def _nearest_of_all(v: DataFrame, targets: DataFrame, line: str, digits: int | None) -> DataFrame:
    """nearest_vertex() from arrays of each line's vertices p_line, px, py, p_order."""
    arrays = v.groupBy(F.col("p_line").alias(line)).agg(F.sort_array(F.collect_list(F.struct("p_order", "px", "py"))).alias("__v"))
    j = targets.join(arrays, line)
    j = j.withColumn("__d", F.transform("__v", lambda p: distance(F.col("x").cast("double"), F.col("y").cast("double"), p["px"], p["py"])))
    j = j.withColumn("__least", F.array_min("__d"))
    # the first of the ties: vertices stand in the order of their numbers
    first = F.array_position("__d", F.col("__least")) if digits is None else F.array_position(F.transform("__d", lambda d: _tied(d, digits)), _tied(F.col("__least"), digits))
    return j.select(*targets.columns, F.get("__v", (first - 1).cast("int"))["p_order"].alias("nearest"), F.col("__least").alias("dist"))


def _nearest_by_cells(v: DataFrame, targets: DataFrame, line: str, size: float, digits: int | None) -> DataFrame:
    """nearest_vertex() on cells whose side is `size` at first."""
    # ties of a vertex are within a cell's side as well
    slack = 0.0 if digits is None else 10.0**-digits
    known = v.select(F.col("p_line").alias(line)).distinct()
    t = written(targets.join(known, line, "left_semi").select(*targets.columns, F.monotonically_increasing_id().alias("__id")))
    rest, found = t.select("__id", F.col(line).alias("__line"), F.col("x").cast("double").alias("__x"), F.col("y").cast("double").alias("__y")), None
    while not rest.isEmpty():
        at = lambda c, size=size: F.floor(F.col(c) / F.lit(size))
        around = rest.withColumn("cx", F.explode(F.array(*[at("__x") + k for k in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(*[at("__y") + k for k in (-1, 0, 1)])))
        j = around.join(v.withColumns({"cx": at("px"), "cy": at("py")}), (F.col("__line") == F.col("p_line")) & (around["cx"] == F.floor(F.col("px") / F.lit(size))) & (around["cy"] == F.floor(F.col("py") / F.lit(size))))
        j = j.withColumn("d", distance(F.col("__x"), F.col("__y"), F.col("px"), F.col("py")))
        best = j.groupBy("__id").agg(F.min(F.struct(_tied(F.col("d"), digits).alias("tied"), "p_order")).alias("m"), F.min("d").alias("d"))
        best = written(best.where(F.col("d") + F.lit(slack) <= size))
        found = best if found is None else found.unionByName(best)
        rest = written(rest.join(best.select("__id"), "__id", "left_anti"))
        size *= 2
    if found is None:
        return t.select(*targets.columns, F.lit(None).cast(v.schema["p_order"].dataType).alias("nearest"), F.lit(None).cast("double").alias("dist"))
    return t.join(found, "__id").select(*targets.columns, F.col("m")["p_order"].alias("nearest"), F.col("d").alias("dist"))


def lines_with_files(nav: DataFrame, files: DataFrame, line: str = "line", file: str = "file", pattern: str = "(.*)_UTM") -> DataFrame:
    """Rows of nav whose line has a file; a file's line is what the pattern finds in its name."""
    return nav.join(files.select(F.regexp_extract(file, pattern, 1).alias(line)), line, "left_semi")
