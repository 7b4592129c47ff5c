"""Command line of the steps: python -m echogrid.plans.cli STEP INPUT OUTPUT [options].

INPUT is a Parquet table of traces or bins, or SEG-Y files (one file, a
directory, or a .txt list). OUTPUT is a Parquet table; steps 01 to 08 write a
directory of SEG-Y files with edited headers instead if --segy is given, and
step 16 always does. Nothing is changed in place. --help after a step lists its
options; parameter files are JSON, or YAML where a YAML package is installed.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amplitudes import parse_gain
from ..functions.headers import line_of_file
from ..functions.units import resampling_factor, scale_coordinate
from ..operators import geometry, merging, spectral
from ..operators.pocs import mask_of
from ..shipping import ship
from ..sources import segy, tables
from . import steps

COORDS = {"source": ("sx", "sy"), "group": ("gx", "gy"), "CDP": ("cdp_x", "cdp_y")}


BYTES = {first: name for name, first, _ in segy.FIELDS}


def read_traces(spark: SparkSession, path: str, suffix: str = "sgy", coords: str = "source", splitter: str = "UTM", ending: str = "", byte_delay: int = 109) -> DataFrame:
    """line, tracl, x, y, delrt, dt (ms), time, file, samples and headers."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    from ..operators.delays import timestamp

    t = segy.read(spark, path, suffix=suffix, ending=ending, fields="all")
    x, y = COORDS[coords]
    unit = F.when(F.col("counit") == 0, 1).otherwise(F.col("counit"))
    c = lambda n: F.col(n)
    return t.withColumns(
        {
            "line": line_of_file(c("file"), splitter),
            "x": scale_coordinate(c(x), c("scalco"), unit),
            "y": scale_coordinate(c(y), c("scalco"), unit),
            "dt": c("dt") / 1000,
            "delrt": c(BYTES[byte_delay]).cast("double"),
            "time": F.when(c("year") > 0, timestamp(c("year"), c("day"), c("hour"), c("minute"), c("sec"))),
        }
    )


def parameters(path: str) -> dict:
    """A parameter file."""
    with open(path) as f:
        if not path.endswith((".yml", ".yaml")):
            return json.load(f)
        import yaml  # optional

        return yaml.safe_load(f)


def _cube(spark: SparkSession, setup: dict):
    xmin, xmax, ymin, ymax = setup["extent"]
    dil, dxl = setup["bin_size"]
    base = geometry.Affine().rotated(-setup.get("rotation", 0), setup.get("centre", (0, 0)))
    m = geometry.coords_to_bins(xmin, xmax, ymin, ymax, dil, dxl, base)
    return m, geometry.bins(spark, round((ymax - ymin) / dil), round((xmax - xmin) / dxl), m)


def _merge(spark, t, o):
    sizes = t.groupBy("file").agg((F.sum(F.size("samples") * 4 + 240) + 3600).alias("size"))
    groups = merging.files_to_merge(sizes, max_bytes=o.filesize_kB * 1000).select(F.explode("files").alias("file"), F.concat(F.get("files", F.lit(0)), F.lit(f"_{o.txt_suffix or 'merge'}")).alias("line"))
    return steps.merge(t.drop("line"), groups, ["fldr", "sx", "sy", "delrt"])


def _aux(spark, t, o):
    """Coordinates from navigation files, where they are asked for."""
    if o.coords_origin == "header":
        return t
    return steps.with_aux_coordinates(t, tables.read_auxiliary(spark, o.coords_path, o.coords_fsuffix or "nav", text=o.coords_text_suffix or "", splitter=o.splitter))


def _statics(spark, t, o):
    d = o.limit_depressions
    pick = {"win": o.win_samples, "nsta": o.nsta, "nlta": o.nlta, "win_median": o.win_median, "n": o.n_amp_samples}
    out = steps.correct_statics(t, o.limit_shift, (int(d[0]), *d[1:]) if d else None, o.mode, o.use_delay, pick, win_sg=o.win_sg, win_mad=o.win_mad)
    return out.withColumn("seafloor_field", F.rint((F.col("delrt") + F.col("pick") * F.col("dt")) * 1000).cast("int")) if o.write_seafloor2trace and o.mode == "amp" else out


def _tides(spark, t, o):
    if o.model_dir:
        return steps.compensate_tide(t, src=o.crs_src, model_dir=o.model_dir, names=o.constituents, correct_minor=o.correct_minor)
    if not o.constituents:
        raise ValueError("give --model_dir or --constituents name:amplitude:phase")
    return steps.compensate_tide(t, {k: (float(a), float(p)) for k, a, p in (c.split(":") for c in o.constituents)}, o.crs_src)


def _misties(spark, t, o):
    t = _aux(spark, t, o)
    window = tuple(o.win_cc) if o.win_cc else None
    if o.write_QC:
        tables.intersections_report(steps.crossings(t, o.cell, window), f"{o.output.rstrip('/')}.qc")
    return steps.correct_misties(t, steps.misties(t, o.cell, o.quality_threshold, window))


def _pre(spark, t, o):
    factor = resampling_factor(o.dt, o.resampling_interval, o.resampling_frequency, o.resampling_factor) if o.resampling_interval or o.resampling_frequency or o.resampling_factor else None
    gain = parse_gain(o.gain) if o.gain else None
    if gain and gain.pop("agc", None):
        gain["agc_win"] = int(gain.pop("agc_win", 0.05) / (o.dt / 1000)) | 1
    return steps.preprocess(t, o.dt, o.balance, gain, o.filter, o.filter_freqs, factor, o.resampling_function == "resample_poly", o.envelope, o.use_samples, o.store_ref_amp)


def _bin(spark, t, o):
    s = parameters(o.params_cube_setup)
    if o.bin_size:
        s["bin_size"] = [o.bin_size[0], o.bin_size[-1]]
    m, bins = _cube(spark, s)
    start, end = o.twt_limits or s["twt_limits"]
    t = _aux(spark, t, o)
    if o.attribute == "env":
        t = t.withColumn("samples", spectral.envelope(F.col("samples")))
    out = steps.bin_traces(t, bins, m, start, round((end - start) / s["dt"]), s["dt"], o.stacking_method, o.factor_dist)
    return out.withColumn("samples", F.col("samples").cast({"float32": "array<float>", "float64": "array<double>"}[o.dtype_data]))


def _pocs(spark, t, o):
    p = parameters(o.path_pocs_parameter)
    fold = spark.read.parquet(p.pop("fold"))
    n_il, n_xl = fold.agg(F.max("il"), F.max("xl")).first()
    return steps.interpolate(t, n_il, n_xl, mask_of(fold, n_il, n_xl), **p)


def _post(spark, t, o):
    n_il, n_xl = t.select("n_il", "n_xl").first() if "n_il" in t.columns else (None, None)
    kind = o.remove_footprint
    if kind and "profile" in kind:
        direction = o.direction or "twt"
    else:
        direction = o.direction or (steps.footprint_direction(*o.bin_size) if o.bin_size else "both")
    filter_ = {"sigma": o.footprint_sigma, "direction": direction, "buffer_center": o.buffer_center, "buffer_filter": o.buffer_filter}
    along = None
    if kind and "profile" in kind:
        along = {"profile-iline": "il", "profile-xline": "xl"}.get(kind)
        if along is None:  # the axis with fewer numbers
            a, b = t.agg(F.count_distinct("il"), F.count_distinct("xl")).first()
            along = "il" if a < b else "xl"
    smooth = {"name": o.smooth, "sigma": o.smooth_sigma, "size": o.smooth_size, "percentiles": None if o.rescale is None else tuple(o.rescale) or (0.01, 99.99)} if o.smooth else None
    if o.agc and not (o.agc_win and o.dt):
        raise SystemExit("--agc needs --agc-win (s) and --dt (ms)")
    agc = {"win": int(round(o.agc_win / (o.dt / 1000), 9)) | 1, "kind": o.agc_kind, "squared": o.agc_sqrt} if o.agc else None
    upsampling = {"method": o.upsample, "dealias": o.spatial_dealiasing} if o.upsample else None
    return steps.postprocess(t, n_il, n_xl, filter_ if kind == "slice" else None, smooth, upsampling, {"along": along, **filter_} if along else None, agc)


SCALARS = [-1000, -100, -10, 0, 10, 100, 1000]
FLAG = {"action": "store_true"}
DELAY = ("--byte_delay", {"type": int, "default": 109, "choices": sorted(BYTES), "metavar": "BYTE", "help": "first byte of the header field that holds the delay"})
AUX = [("--coords_origin", {"choices": ["header", "aux"], "default": "header"}), ("--coords_path", {}), ("--coords_fsuffix", {"choices": sorted(tables.SCHEMAS)}), ("--coords_text_suffix", {})]
#: Columns of the CSV files that --write_aux adds, a directory a line, beside the output.
AUX_COLUMNS = {"05": ("tracl", "tracr", "fldr", "static", "pick"), "06": ("tracl", "tracr", "fldr", "time", "tide", "tide_samples"), "07": ("tracl", "tracr", "fldr", "mistie"), "10": ("il", "xl", "x", "y", "fold")}
#: Step: what it does, (flag, keywords for argparse) of its options, what runs.
COMMANDS = {
    "01": ("merge short files", [("--filesize_kB", {"type": int, "default": 2000})], _merge),
    "02": ("reproject", [("--crs_src", {"required": True}), ("--crs_dst", {"required": True}), ("--scalar_coords", {"type": int, "default": -100, "choices": SCALARS}), ("--dst_coords", {"choices": sorted(COORDS), "default": "source"}), ("--smooth", {"type": int, "nargs": "?", "const": 11})], lambda s, t, o: steps.reproject(t, o.crs_src, o.crs_dst, smooth=o.smooth)),
    "03": ("correct delays", [DELAY, ("--win_ntraces", {"type": int, "default": 5}), ("--win_nsamples", {"type": int, "default": 120})], lambda s, t, o: steps.correct_delays(t, o.win_ntraces, o.win_nsamples)),
    "04": ("pad delays", [DELAY], lambda s, t, o: steps.pad_delays(t)),
    "05": (
        "correct statics",
        [DELAY, ("--use_delay", FLAG), ("--mode", {"choices": ["amp", "swdep"], "default": "amp"}), ("--win_samples", {"type": int, "default": 30}), ("--nsta", {"type": int}), ("--nlta", {"type": int}), ("--win_median", {"type": int, "default": 11}), ("--n_amp_samples", {"type": int, "default": 5}), ("--win_mad", {"type": int}), ("--win_sg", {"type": int, "default": 7}), ("--limit_shift", {"type": float, "nargs": "?", "default": 12, "const": 12}), ("--limit_depressions", {"type": float, "nargs": "+", "default": [10, 10, 5]}), ("--write_seafloor2trace", FLAG), ("--write_aux", FLAG)],
        _statics,
    ),
    "06": ("compensate tide", [("--model_dir", {"help": "Parquet table of constituent, lat, lon, amplitude, phase"}), ("--correct_minor", FLAG), ("--constituents", {"nargs": "+", "help": "names of the model's, or name:amplitude:phase without a model"}), ("--crs_src", {"default": "epsg:32760"}), ("--write_aux", FLAG)], _tides),
    "07": ("correct misties", [*AUX, ("--cell", {"type": float, "default": 50.0}), ("--win_cc", {"type": float, "nargs": 2, "help": "first and last time that are compared, ms"}), ("--quality_threshold", {"type": float, "default": 0.5}), ("--write_aux", FLAG), ("--write_QC", FLAG)], _misties),
    "08": ("despike", [DELAY, ("--window_time", {"type": float, "required": True}), ("--dt", {"type": float, "required": True}), ("--window_traces", {"type": int, "default": 5}), ("--window_overlap", {"type": float, "default": 10}), ("--mode", {"choices": ["mean", "median", "rms"], "default": "mean"}), ("--threshold_factor", {"type": float, "default": 2.0}), ("--out_amplitude", {"choices": ["scaled", "mode", "threshold", "zeros", "median"], "default": "threshold"}), ("--use_delay", FLAG)], lambda s, t, o: steps.despike(t, o.use_delay, window=o.window_time, dt=o.dt, overlap=o.window_overlap, ntraces=o.window_traces, mode=o.mode, threshold=o.threshold_factor, out=o.out_amplitude)),
    "09": ("convert to a table", [], lambda s, t, o: t),
    "10": ("bin and stack", [*AUX, ("--params_cube_setup", {"required": True}), ("--attribute", {"choices": ["amp", "env"], "default": "amp"}), ("--bin_size", {"type": float, "nargs": "+"}), ("--twt_limits", {"type": float, "nargs": 2}), ("--stacking_method", {"choices": ["average", "median", "nearest", "idw"], "default": "average"}), ("--factor_dist", {"type": float, "default": 1.0}), ("--dtype_data", {"choices": ["float32", "float64"], "default": "float64"}), ("--write_aux", FLAG)], _bin),
    "11": ("pre-process", [("--dt", {"type": float, "required": True}), ("--gain", {"nargs": "*"}), ("--use_samples", FLAG), ("--balance", {"nargs": "?", "const": "rms", "choices": ["rms", "max"]}), ("--store_ref_amp", FLAG), ("--filter", {"choices": ["lowpass", "highpass", "bandpass"]}), ("--filter_freqs", {"type": float, "nargs": "+"}), ("--resampling_function", {"choices": ["resample", "resample_poly"], "default": "resample_poly"}), ("--resampling_interval", {"type": float}), ("--resampling_frequency", {"type": float}), ("--resampling_factor", {"type": float}), ("--window_resample", {"choices": ["hann"], "default": "hann"}), ("--envelope", FLAG)], _pre),
    "12": ("to frequencies", [("--dt", {"type": float, "required": True}), ("--compute_real", FLAG), ("--upsampling-factor", {"type": int, "default": 1}), ("--filter", {"choices": ["lowpass", "highpass", "bandpass"]}), ("--filter_freqs", {"type": float, "nargs": "+"}), ("--drop-filtered-freq", FLAG)], lambda s, t, o: steps.to_frequency(t, o.dt, o.upsampling_factor, o.compute_real, o.filter, o.filter_freqs, o.drop_filtered_freq)),
    "13": ("fill empty bins", [("--path_pocs_parameter", {"required": True})], _pocs),
    "14": ("to time", [("--dt", {"type": float, "required": True}), ("--n", {"type": int}), ("--compute_real", FLAG), ("--rescale-envelope", FLAG)], lambda s, t, o: steps.to_time(t, o.dt, o.n, o.compute_real, o.rescale_envelope)),
    "15": (
        "post-process slices or traces of the cube",
        [("--upsample", {"nargs": "?", "const": "linear", "choices": list(spectral.UPSAMPLING)}), ("--spatial-dealiasing", FLAG), ("--remove-footprint", {"nargs": "?", "const": "slice", "choices": ["slice", "profile", "profile-iline", "profile-xline"]}), ("--direction", {"choices": ["both", "iline", "xline", "twt"]}), ("--bin-size", {"type": float, "nargs": 2, "help": "along inlines and crosslines, from which the direction follows"}), ("--footprint-sigma", {"type": float, "default": 7}), ("--buffer-center", {"type": float, "default": 0.2}), ("--buffer-filter", {"type": int, "default": 3}), ("--smooth", {"nargs": "?", "const": "gaussian", "choices": ["gaussian", "median"]}), ("--smooth-sigma", {"type": float, "default": 1}), ("--smooth-size", {"type": int, "default": 3}), ("--rescale", {"type": float, "nargs": "*"}), ("--agc", FLAG), ("--agc-win", {"type": float}), ("--agc-kind", {"choices": ["rms", "mean", "median"], "default": "rms"}), ("--agc-sqrt", FLAG), ("--dt", {"type": float})],
        _post,
    ),
    "16": ("export as SEG-Y", [("--dt", {"type": float, "required": True}), ("--scalar_coords", {"default": "auto", "choices": [*map(str, SCALARS), "auto"]}), ("--inlines_per_file", {"type": int})], None),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echogrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="step", required=True)
    for step, (what, options, _) in COMMANDS.items():
        c = sub.add_parser(step, help=what)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--suffix", default="sgy")
        c.add_argument("--filename_suffix", default="", help="what the names of the files read end with, before the dot")
        c.add_argument("--src_coords", choices=sorted(COORDS), default="source")
        c.add_argument("--splitter", default="UTM")
        if step <= "08":
            c.add_argument("--segy", action="store_true", help="write SEG-Y files with edited headers")
            c.add_argument("--txt_suffix", default="", help="what is added to the names of files written")
        for flag, keywords in options:
            c.add_argument(flag, **keywords)
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    o = parser().parse_args(argv)
    ship(spark)
    t = read_traces(spark, o.input, o.suffix, o.src_coords, o.splitter, o.filename_suffix, getattr(o, "byte_delay", 109))
    if o.step == "16":
        n_xl = t.agg(F.max("xl")).first()[0]
        steps.export_segy(t, o.output, round(o.dt * 1000), n_xl, o.scalar_coords, inlines_per_file=o.inlines_per_file)
        return
    what, _, command = COMMANDS[o.step]
    out = command(spark, t, o)
    if getattr(o, "segy", False):
        coords = COORDS[getattr(o, "dst_coords", o.src_coords)]
        steps.to_segy(out, o.output, o.txt_suffix, what.upper(), coords, getattr(o, "scalar_coords", None)).count()
    else:
        out.write.parquet(o.output)
    if getattr(o, "write_aux", False):
        d = out if o.step == "10" or getattr(o, "segy", False) else spark.read.parquet(o.output)
        d.select(*[c for c in ("line", *AUX_COLUMNS[o.step]) if c in d.columns]).write.csv(f"{o.output.rstrip('/')}.aux", header=True)


def main(argv: list[str] | None = None) -> None:
    import sys

    run(SparkSession.builder.appName("echogrid").getOrCreate(), sys.argv[1:] if argv is None else argv)


__all__ = ["COMMANDS", "main", "parameters", "parser", "read_traces", "run"]

if __name__ == "__main__":
    main()
