"""The sixteen processing steps, DataFrame in and DataFrame out.

Traces are rows (line, tracl, delrt, dt, samples, ...). Each step is a logical
plan; nothing runs before its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amplitudes, crs, headers, units
from ..kernels import slices as slice_kernels
from ..layouts import even, from_slices, to_samples, to_slices, to_traces
from ..operators import bands, binning, delays, geometry, joins, lines, merging, pocs, spectral, tides, windows
from ..sources import segy, tables


def merge(traces: DataFrame, groups: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """01: files of a group (file, line) become one gapless line."""
    return merging.merged(traces.drop("line").join(groups, "file"), headers=fields)


def reproject(traces: DataFrame, src: str, dst: str, x: str = "x", y: str = "y", smooth: int | None = None) -> DataFrame:
    """02: coordinates to another system; smooth takes a centred mean of so many traces first."""
    d = traces
    if smooth:
        w = windows.over(["line"], ["tracl"], -(smooth // 2), smooth // 2)
        d = d.withColumns({x: F.avg(x).over(w), y: F.avg(y).over(w)})
    nx, ny = crs.transform(F.col(x), F.col(y), src, dst)
    return d.withColumns({x: nx, y: ny})


def correct_delays(traces: DataFrame, n_traces: int = 5, n_samples: int = 120) -> DataFrame:
    """03: delays that a header has one trace off."""
    new = delays.correct_delays(traces, n_traces=n_traces, n_samples=n_samples)
    return traces.join(new, ["line", "tracl"], "left").withColumn("delrt", F.coalesce("delrt_new", "delrt")).drop("delrt_new")


def pad_delays(traces: DataFrame) -> DataFrame:
    """04: all traces of a line on one axis."""
    return delays.pad_delays(traces).drop("n_before")


def correct_statics(traces: DataFrame, limit_samples: float | None = 12, depressions: tuple | None = (10, 10, 5), mode: str = "amp", use_delay: bool = False, pick: dict | None = None, **options) -> DataFrame:
    """05: seafloor picked (or taken from the headers' water depth: swdep), static found, traces moved; adds pick and static.

    use_delay counts picks from the line's least delay. In mode swdep, pick is
    the depth in m, and lines with a trace without depth stay as they are.
    """
    if mode == "swdep":
        deep = delays.swdep_scaled(traces.select("line", "tracl", "swdep", "scalel"))
        known = deep.withColumn("least", F.min(F.abs("swdep")).over(windows.whole(["line"]))).where("least > 0")
        s = lines.statics(known.select("line", "tracl", F.col("swdep").alias("pick")), limit_samples=limit_samples, depressions=depressions, **options)
        d = traces.join(s, ["line", "tracl"], "left")
        d = d.withColumn("static", F.rint(units.depth2samples(F.coalesce("static", F.lit(0.0)), F.col("dt"), units="ms")))
    elif mode == "amp":
        picks = lines.pick_seafloor(traces, **(pick or {}))
        if use_delay:
            picks = delays.delay_offset(picks.join(traces.select("line", "tracl", "delrt", "dt"), ["line", "tracl"])).select("line", "tracl", "pick")
        d = traces.join(lines.statics(picks, limit_samples=limit_samples, depressions=depressions, **options), ["line", "tracl"])
    else:
        raise ValueError(f"mode {mode!r} is neither amp nor swdep")
    return d.withColumn("samples", amplitudes.compensate_static(F.col("samples"), F.col("static")))


def compensate_tide(traces: DataFrame, constituents: dict[str, tuple[float, float]] | None = None, src: str = "epsg:32760", model_dir: str | None = None, names: list[str] | None = None, correct_minor: bool = False) -> DataFrame:
    """06: the tide at each distinct place, at the time of its first trace, taken from all traces there.

    It comes from amplitudes and phases that hold everywhere, or from the
    gridded model in model_dir (operators.tides.read_model), from its
    constituents `names` or all; places on the model's land have no tide.
    """
    lon, lat = crs.transform(F.col("x"), F.col("y"), src, "epsg:4326")
    d = traces.withColumns({"lon": lon, "lat": lat})
    if model_dir is not None:
        model, raster, known = tides.read_model(traces.sparkSession, model_dir)
        missing = sorted({n.lower() for n in names or []} - set(known))
        if missing:
            raise ValueError(f"the model lacks {', '.join(missing)}")
        chosen = sorted({n.lower() for n in names}) if names else known
        tide = lambda p: tides.predict(p, model, raster, chosen, correct_minor).withColumn("tide", F.coalesce("tide", F.lit(0.0)))
    else:
        tide = lambda p: p.withColumn("tide", delays.harmonic_tide(F.col("time"), constituents or {}))
    d = delays.at_distinct(d, ["lon", "lat"], F.col("time"), tide)
    n = amplitudes.tide_samples(F.col("tide"), F.col("dt"))
    return d.withColumn("tide_samples", n).withColumn("samples", amplitudes.compensate_tide(F.col("samples"), F.col("tide_samples")))


def crossings(traces: DataFrame, cell: float, window: tuple[float, float] | None = None) -> DataFrame:
    """line_a, line_b, x, y, tracl_a, tracl_b, lag, r of the traces at the crossings of lines; window: first and last time (ms) that are compared."""
    t = lines.bad_traces_mixed(traces.drop("x", "y") if window is None else _within(traces.drop("x", "y"), window))
    cross = joins.intersections(joins.segments(traces), cell).select("line_a", "line_b", "x", "y")
    a = joins.nearest_vertex(traces, cross, "line_a").select("line_a", "line_b", "x", "y", F.col("nearest").alias("tracl_a"))
    b = joins.nearest_vertex(traces, a, "line_b").withColumnRenamed("nearest", "tracl_b")
    s = lambda k: t.select(F.col("line").alias(f"line_{k}"), F.col("tracl").alias(f"tracl_{k}"), F.col("samples").alias(f"samples_{k}"))
    pairs = b.join(s("a"), ["line_a", "tracl_a"]).join(s("b"), ["line_b", "tracl_b"])
    return lines.correlate(pairs).drop("samples_a", "samples_b")


def _within(traces: DataFrame, window: tuple[float, float]) -> DataFrame:
    at = lambda t: F.rint((F.lit(float(t)) - F.coalesce(F.col("delrt"), F.lit(0.0))) / F.col("dt")).cast("int")
    lo, hi = F.greatest(at(window[0]), F.lit(0)), at(window[1])
    return traces.withColumn("samples", F.slice("samples", lo + 1, F.greatest(hi - lo + 1, F.lit(0))))


def misties(traces: DataFrame, cell: float, quality: float = 0.5, window: tuple[float, float] | None = None) -> DataFrame:
    """The shift of each line from the traces at the crossings."""
    return lines.line_shifts(crossings(traces, cell, window).select("line_a", "line_b", "lag", "r"), quality)


def correct_misties(traces: DataFrame, shifts: DataFrame) -> DataFrame:
    """07: every line moved by its shift; lines without one stay."""
    d = traces.join(shifts, "line", "left").withColumn("mistie", F.coalesce("shift", F.lit(0)))
    return d.withColumn("samples", amplitudes.compensate_mistie(F.col("samples"), F.col("mistie"))).drop("shift")


def despike(traces: DataFrame, use_delay: bool = False, **options) -> DataFrame:
    """08: bursts damped; with use_delay, stretches of equal delay apart."""
    d = windows.segments(traces, ["line"], ["tracl"], "delrt") if use_delay else traces
    e = lines.despike(d, "segment" if use_delay else None, **options)
    return traces.drop("samples").join(e, ["line", "tracl"])


def convert(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """09: SEG-Y files to a table."""
    segy.read(spark, path, **options).write.parquet(out)
    return spark.read.parquet(out)


def bin_traces(traces: DataFrame, bins: DataFrame, transform: geometry.Affine, t0: float, n: int, dt: float, method: str = "average", factor: float = 1.0) -> DataFrame:
    """10: traces to bins of the cube, on one time axis: il, xl, x, y, fold, samples."""
    d = geometry.trace_bins(traces, transform)
    d = d.withColumn("samples", amplitudes.fit_axis(F.col("samples"), F.col("delrt"), F.lit(dt), F.lit(t0), n))
    centre = bins.select("il", "xl", F.col("x").alias("bx"), F.col("y").alias("by"))
    d = d.join(centre, ["il", "xl"]).withColumn("dist", geometry.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")))
    return binning.stack_traces(d, bins, n, method, factor)


def preprocess(cube: DataFrame, dt: float, balance: str | None = None, gain: dict | None = None, filter_kind: str | None = None, filter_freqs=None, resampling: float | None = None, poly: bool = True, envelope: bool = False, use_samples: bool = False, store_reference: bool = True) -> DataFrame:
    """11: balance, gain, filter, resample, envelope, in this order; store_reference keeps what a trace was divided by."""
    s = "samples"
    if balance:
        cube = cube.withColumn("reference", amplitudes.reference(F.col(s), balance)).withColumn(s, amplitudes.divided(F.col(s), F.col("reference")))
        cube = cube if store_reference else cube.drop("reference")
    if gain:
        t = F.transform(s, lambda x, i: i.cast("double") * (1.0 if use_samples else dt))
        cube = cube.withColumn(s, amplitudes.gain(F.col(s), t, **gain))
    if filter_kind:
        cube = cube.withColumn(s, spectral.filter_frequency(F.col(s), filter_freqs, 1 / dt, filter_kind))
    if resampling:
        cube = cube.withColumn(s, (spectral.resample_poly if poly else spectral.resample)(F.col(s), resampling))
    return cube.withColumn(s, spectral.envelope(F.col(s))) if envelope else cube


def to_frequency(cube: DataFrame, dt: float, upsampling: int = 1, real: bool = True, filter_kind: str | None = None, filter_freqs=None, drop: bool = False) -> DataFrame:
    """12: il, xl, i, f, re, im: the spectrum of each bin's trace, tapered."""
    d = cube.withColumn("spec", spectral.fft(even("samples"), dt, 0.0, upsampling, real))
    e = d.select("il", "xl", F.posexplode(F.arrays_zip("spec.f", "spec.re", "spec.im")).alias("i", "z")).select("il", "xl", "i", F.col("z.f").alias("f"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))
    if filter_kind:
        w = spectral.taper(F.col("f"), filter_freqs, filter_kind)
        e = e.withColumns({"re": F.col("re") * w, "im": F.col("im") * w})
        if drop:
            e = e.where(spectral.keeps(F.col("f"), filter_freqs, filter_kind))
    return e


def interpolate(spectra: DataFrame, n_il: int, n_xl: int, mask, resume_path: str | None = None, **options) -> DataFrame:
    """13: frequency slices filled by projection; with resume_path, in batches that are kept there, so that a run that was stopped goes on."""
    if resume_path:
        return pocs.resume(to_slices(spectra, n_il, n_xl, "re", "im"), mask, resume_path, **options)
    return pocs.interpolate(to_slices(spectra, n_il, n_xl, "re", "im"), mask, **options)


def interpolate_large(spectra: DataFrame, bins: DataFrame, n_il: int, n_xl: int, values: int = 1 << 22, **options) -> DataFrame:
    """13, for slices that no task holds: il, xl, i, re, im, niter, cost, filled in bands and strips of about so many values.

    bins are rows (il, xl, fold). The options are those of operators.bands.interpolate.
    """
    shape = bands.Shape.of(n_il, n_xl, values)
    out = bands.interpolate(bands.to_bands(spectra, shape, "re", "im"), bands.mask_of(bins, shape), shape, complex_in=True, **options)
    ends = out.select("slice", "niter", "cost").distinct()  # a row a slice
    long = bands.from_bands(out, shape).withColumnRenamed("slice", "i").withColumnsRenamed({"amp": "re", "imag": "im"})
    return long.join(ends.withColumnRenamed("slice", "i"), "i")


def to_time_large(spectra: DataFrame, dt: float, n: int | None = None, real: bool = True) -> DataFrame:
    """14, from rows (il, xl, i, re, im): il, xl, samples."""
    g = spectra.groupBy("il", "xl").agg(F.array_sort(F.collect_list(F.struct("i", "re", "im"))).alias("s"))
    spec = F.struct(F.transform("s", lambda v: v["re"]).alias("re"), F.transform("s", lambda v: v["im"]).alias("im"))
    return g.withColumn("spec", spec).select("il", "xl", spectral.ifft(F.col("spec"), dt, 0.0, n, real).alias("samples"))


def rescaled_envelopes(cube: DataFrame, samples: str = "samples") -> DataFrame:
    """Negative samples to zero, then all to 0..1 by the cube's least and largest, one row that is joined."""
    d = cube.withColumn(samples, F.transform(samples, lambda x: F.greatest(x, F.lit(0.0))))
    ends = d.agg(F.min(F.array_min(samples)).alias("__lo"), F.max(F.array_max(samples)).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return d.crossJoin(F.broadcast(ends)).withColumn(samples, F.when(span > 0, F.transform(samples, lambda x: (x - F.col("__lo")) / span)).otherwise(F.col(samples))).drop("__lo", "__hi")


def to_time(slices: DataFrame, dt: float, n: int | None = None, real: bool = True, rescale_envelope: bool = False) -> DataFrame:
    """14: il, xl, samples from frequency slices; rescale_envelope brings an envelope's cube to 0..1."""
    e = slices.select("slice", "n_xl", F.posexplode(F.arrays_zip("grid", "imag")).alias("k", "z"))
    il, xl = (F.floor(F.col("k") / F.col("n_xl")) + 1).cast("int"), (F.col("k") % F.col("n_xl") + 1).cast("int")
    g = e.groupBy(il.alias("il"), xl.alias("xl")).agg(F.array_sort(F.collect_list(F.struct("slice", F.col("z.grid").alias("re"), F.col("z.imag").alias("im")))).alias("s"))
    spec = F.struct(F.transform("s", lambda v: v["re"]).alias("re"), F.transform("s", lambda v: v["im"]).alias("im"))
    out = g.withColumn("spec", spec).select("il", "xl", spectral.ifft(F.col("spec"), dt, 0.0, n, real).alias("samples"))
    return rescaled_envelopes(out) if rescale_envelope else out


def step_of(cube: DataFrame, axis: str) -> int:
    """The least difference between numbers of an axis that the cube holds; 1 for a single one."""
    w = windows.Window.orderBy(axis)  # over the numbers of one axis, some thousand
    d = cube.select(axis).distinct().withColumn("d", F.col(axis) - F.lag(axis).over(w))
    return d.agg(F.min("d")).first()[0] or 1


def upsample(cube: DataFrame, method: str = "linear", dealias: bool = True, sigma: float = 7) -> DataFrame:
    """Traces (il, xl, samples) on every number of both axes, so that bins get equal sizes; dealias damps what the axis that was filled can't hold."""
    steps = {axis: step_of(cube, axis) for axis in ("il", "xl")}
    if set(steps.values()) == {1}:
        return cube.select("il", "xl", "samples")
    long = cube.select("il", "xl", F.posexplode("samples").alias("i", "amp"))
    for axis, other in (("il", "xl"), ("xl", "il")):
        if steps[axis] != 1:
            long = spectral.upsample(long, axis, [other, "i"], method=method)
    if dealias:
        lo_il, hi_il, lo_xl, hi_xl = long.agg(F.min("il"), F.max("il"), F.min("xl"), F.max("xl")).first()
        n_il, n_xl = hi_il - lo_il + 1, hi_xl - lo_xl + 1
        own = long.select((F.col("il") - lo_il + 1).alias("il"), (F.col("xl") - lo_xl + 1).alias("xl"), "i", "amp")
        direction = "iline" if steps["il"] != 1 else "xline"
        sl = spectral.antialias(to_slices(own, n_il, n_xl), n_il, n_xl, (steps["il"], steps["xl"]), direction, sigma)
        long = from_slices(sl).select((F.col("il") + lo_il - 1).alias("il"), (F.col("xl") + lo_xl - 1).alias("xl"), F.col("slice").alias("i"), "amp")
    return to_traces(long, "il", "xl")


def footprint_on_profiles(cube: DataFrame, along: str = "il", **options) -> DataFrame:
    """The footprint filter on each inline (along = il) or crossline: traces of one profile are a matrix of traces and samples."""
    across = "xl" if along == "il" else "il"
    options = {"direction": "twt"} | options

    def run(pdf):
        pdf = pdf.sort_values(across)
        x = np.stack(pdf["samples"].to_list()).astype(float)
        return pdf.assign(samples=list(slice_kernels.filtered(x, slice_kernels.footprint_filter(x.shape, **options))))

    d = cube.select("il", "xl", F.col("samples").cast("array<double>").alias("samples"))
    return d.groupBy(along).applyInPandas(run, d.schema)


def footprint_direction(bin_il: float, bin_xl: float) -> str:
    """Both for square bins, else the axis of the smaller bins."""
    return "both" if bin_il == bin_xl else "iline" if bin_il < bin_xl else "xline"


def postprocess(
    cube: DataFrame, n_il: int | None = None, n_xl: int | None = None, footprint: dict | None = None, smooth: dict | None = None, upsampling: dict | None = None, profiles: dict | None = None, agc: dict | None = None
) -> DataFrame:
    """15: bins made equal, acquisition footprint removed, slices smoothed, gain over time.

    footprint and smooth work on slices; upsampling, profiles (along, and
    options of the footprint filter) and agc (win in samples, kind, squared) on
    traces. The two layouts exclude each other but for upsampling, which comes
    first and whose traces become slices.
    """
    if (profiles or agc) and (footprint is not None or smooth is not None or upsampling):
        raise ValueError("gain and footprint on profiles need traces, the others slices: run the step twice")
    if profiles:
        cube = footprint_on_profiles(cube, **profiles)
    if agc:
        return cube.withColumn("samples", spectral.agc(F.col("samples"), **agc))
    if upsampling:
        cube = upsample(cube, **upsampling)
        if footprint is None and smooth is None:
            return cube
        n_il, n_xl = cube.agg(F.max("il"), F.max("xl")).first()
        cube = to_slices(to_samples(cube), n_il, n_xl)
    if footprint is not None:
        cube = spectral.remove_footprint(cube, n_il, n_xl, **footprint)
    return spectral.smooth_slices(cube, **smooth) if smooth is not None else cube


def with_aux_coordinates(traces: DataFrame, nav: DataFrame) -> DataFrame:
    """x and y from navigation files, by line and trace number; traces without an entry keep their own."""
    n = nav.select("line", "tracl", F.col("x").alias("aux_x"), F.col("y").alias("aux_y"))
    return traces.join(n, ["line", "tracl"], "left").withColumns({"x": F.coalesce("aux_x", "x"), "y": F.coalesce("aux_y", "y")}).drop("aux_x", "aux_y")


def to_segy(traces: DataFrame, path: str, suffix: str = "", info: str = "", coords: tuple[str, str] = ("sx", "sy"), scalar: int | None = None) -> DataFrame:
    """Files of traces with edited headers: one a line, its name that of the file read with `_suffix`, or the line's.

    x and y go to the header fields `coords`, by the traces' own scalar or the
    one given; delay and interval to theirs; statics, where there are any, in
    thousandths of ms to TotalStaticApplied with their scalar.
    """
    has = traces.columns
    tail = f"_{suffix}.sgy" if suffix else ".sgy"
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", tail) if "file" in has else F.concat(F.col("line").cast("string"), F.lit(tail))
    sc = F.lit(scalar) if scalar is not None else F.when(F.coalesce("scalco", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("scalco")) if "scalco" in has else F.lit(-100)
    new = {"file": name, "trace": F.col("tracl"), "scalco": sc.cast("int"), "dt": F.rint(F.col("dt") * 1000).cast("int")}
    new |= {h: F.rint(units.unscale_coordinate(F.col(c), sc)).cast("int") for h, c in zip(coords, ("x", "y"), strict=True) if c in has}
    if "delrt" in has:
        new["delrt"] = F.rint("delrt").cast("int")
    if "static" in has:
        new |= {"tstat": F.rint(F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.col("static") * F.col("dt") * 1000))).cast("int"), "static_field": F.lit(-1000)}
    text = "".join(headers.prefixed(i + 1, headers.TITLE.center(77) if i == 24 else f" {info}" if i == 25 else "") for i in range(headers.LINES))
    fields = [n for n, _, _ in segy.FIELDS if n in has and n not in new]
    return segy.write(traces.select(*[v.alias(k) for k, v in new.items()], *fields, "samples"), path, text=text)


def auto_scalar(cube: DataFrame, x: str = "x", y: str = "y") -> int:
    """The largest power of ten that keeps all coordinates within a header's integer."""
    most = cube.agg(F.max(F.greatest(F.abs(x), F.abs(y)))).first()[0] or 1.0
    return -max(k for k in (1, 10, 100, 1000) if most * k < 2**31 or k == 1)


def export_segy(cube: DataFrame, path: str, dt_us: int, n_xl: int, scalar: int | str = -100, file: str = "cube.sgy", inlines_per_file: int | None = None) -> DataFrame:
    """16: the cube in inline order. One file is one task, so a large cube goes to a file for each block of so many inlines; cdp numbers run through."""
    scalar = auto_scalar(cube) if scalar == "auto" else int(scalar)
    u = lambda c: units.unscale_coordinate(F.col(c), F.lit(scalar))
    block = F.floor((F.col("il") - 1) / F.lit(inlines_per_file)) * inlines_per_file + 1 if inlines_per_file else None
    name = F.lit(file) if block is None else F.concat(F.lit(file.removesuffix(".sgy") + "_il"), F.lpad(block.cast("string"), 6, "0"), F.lit(".sgy"))
    d = cube.select(name.alias("file"), ((F.col("il") - 1) * n_xl + F.col("xl")).alias("cdp"), F.col("il").alias("iline"), F.col("xl").alias("xline"), u("x").alias("cdp_x"), u("y").alias("cdp_y"), F.lit(scalar).alias("scalco"), F.lit(dt_us).alias("dt"), "samples")
    return segy.write(d.withColumn("trace", F.col("cdp")), path)


STEPS: dict[str, Callable] = {
    "01": merge, "02": reproject, "03": correct_delays, "04": pad_delays, "05": correct_statics, "06": compensate_tide, "07": correct_misties, "08": despike,
    "09": convert, "10": bin_traces, "11": preprocess, "12": to_frequency, "13": interpolate, "14": to_time, "15": postprocess, "16": export_segy,
}
__all__ = ["STEPS", "tables"]
