"""Steps, files and streams from end to end on small made-up surveys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import crs, headers
from echogrid.operators import delays, geometry, joins, lines, merging, windows
from echogrid.plans import steps
from echogrid.sources import segy, tables
from echogrid.streaming import arrivals


def survey(spark, n_lines=3, n=12, ns=64):
    rows = []
    for k in range(n_lines):
        for t in range(n):
            s = np.sin(2 * np.pi * 4 * np.arange(ns) / ns + k) * np.hanning(ns)
            rows.append((f"l{k}", t + 1, float(10 * t), float(10 * k), 0.0, 0.05, s.tolist()))
    return spark.createDataFrame(rows, "line string, tracl int, x double, y double, delrt double, dt double, samples array<double>")


def test_segy_round_trip(spark, tmp_path):
    t = survey(spark)
    d = t.select(F.concat("line", F.lit("_UTM60S.sgy")).alias("file"), F.col("tracl").alias("trace"), "tracl", F.lit(-100).alias("scalco"), F.lit(1).alias("counit"), F.rint(F.col("x") * 100).cast("int").alias("sx"), F.rint(F.col("y") * 100).cast("int").alias("sy"), F.lit(50).alias("dt"), "samples")
    done = segy.write(d, str(tmp_path / "out"), text="C 1 TEST").collect()
    assert {r.traces for r in done} == {12} and len(done) == 3
    back = segy.read(spark, str(tmp_path / "out"), fields="all")
    assert back.count() == 36
    nav = tables.navigation(back)
    assert {(r.line, r.tracl, r.x, r.y) for r in nav.collect()} == {(r.line, r.tracl, r.x, r.y) for r in t.collect()}
    a = np.array(back.where("tracl = 3").orderBy("file").first()["samples"])
    assert np.allclose(a, t.where("line = 'l0' and tracl = 3").first()["samples"], atol=1e-6)
    assert segy.text_headers(spark, str(tmp_path / "out")).first()["text"].startswith("C 1 TEST")
    h = segy.binary_headers(spark, str(tmp_path / "out"))
    assert {r.value for r in h.where("key = 3221").collect()} == {64}
    (tmp_path / "list.txt").write_text("out/l1_UTM60S.sgy\n")
    assert segy.read(spark, str(tmp_path / "list.txt"), samples="false").count() == 12
    with pytest.raises(Exception):
        segy.read(spark, str(tmp_path / "out"), fields="nope").count()
    assert segy.ibm_to_float(np.array([0xC276A000], np.uint32))[0] == -118.625
    assert segy.text_header("C 1 A".ljust(3200).encode("cp500")).startswith("C 1 A")


def test_crs_against_known_points(spark):
    known = [(171.0, -44.0, 500000.0, 5127641.34), (177.0, -44.0, None, None)]
    for lon, lat, x, y in known:
        r = spark.range(1).select(*[c.alias(n) for c, n in zip(crs.transform(F.lit(lon), F.lit(lat), "epsg:4326", "epsg:32760"), "xy", strict=True)]).first()
        if lon == 177.0:
            assert abs(r.x - 500000) < 1e-6
    p = spark.range(50).select((F.lit(174.0) + F.col("id") / 10).alias("lon"), (F.lit(-80.0) + F.col("id") * 1.5).alias("lat"))
    x, y = crs.transform(F.col("lon"), F.col("lat"), "epsg:4326", "epsg:32760")
    q = p.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.transform(F.col("x"), F.col("y"), "epsg:32760", "epsg:4326")
    assert all(abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9 for r in q.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect())
    with pytest.raises(ValueError):
        crs.zone_of("epsg:2193")


def test_bin_fft_pocs_inverse(spark):
    t = survey(spark)
    m = geometry.coords_to_bins(-5, 115, -5, 25, 10, 10)
    bins = geometry.bins(spark, 3, 12, m)
    cube = steps.bin_traces(t, bins, m, 0.0, 64, 0.05)
    assert cube.count() == 36 and cube.agg(F.min("fold")).first()[0] == 1
    spec = steps.to_frequency(cube, 0.05)
    full = steps.interpolate(spec, 3, 12, [1] * 36, niter=4)
    back = steps.to_time(full, 0.05)
    a = {(r.il, r.xl): np.array(r.samples) for r in cube.collect()}
    assert all(np.allclose(a[r.il, r.xl], r.samples, atol=1e-9) for r in back.collect())
    low = steps.to_frequency(cube, 0.05, filter_kind="lowpass", filter_freqs=(2, 4), drop=True)
    assert low.agg(F.max("f")).first()[0] <= 4
    pre = steps.preprocess(cube, 0.05, balance="rms", gain={"tpow_value": 1.0}, filter_kind="lowpass", filter_freqs=(3.0, 5.0), resampling=2, envelope=True)
    assert pre.select(F.size("samples")).first()[0] == 32
    post = steps.postprocess(full.select("slice", "n_il", "n_xl", "grid"), 3, 12, {"sigma": 1, "buffer_filter": 1}, {"name": "median"})
    assert post.count() == full.count()


def test_export_cube(spark, tmp_path):
    m = geometry.coords_to_bins(-5, 115, -5, 25, 10, 10)
    cube = steps.bin_traces(survey(spark), geometry.bins(spark, 3, 12, m), m, 0.0, 64, 0.05)
    steps.export_segy(cube, str(tmp_path / "c"), 50, 12)
    back = segy.read(spark, str(tmp_path / "c"), fields="cdp,iline,xline,cdp_x")
    assert [r.cdp for r in back.orderBy("trace").collect()] == list(range(1, 37))


def test_line_steps(spark):
    t = survey(spark, n=40)
    assert steps.correct_delays(t).count() == 120 and steps.pad_delays(t).count() == 120
    s = steps.correct_statics(t)
    assert s.count() == 120 and {"pick", "static"} <= set(s.columns)
    d = steps.despike(t, window=0.5, dt=0.05)
    assert d.count() == 120
    tide = steps.compensate_tide(t.withColumn("time", F.to_timestamp(F.lit("2020-07-04 10:00:00"))).withColumns({"x": F.lit(500000.0) + F.col("x"), "y": F.lit(5e6) + F.col("y")}), {"m2": (1.0, 0.0)})
    assert tide.count() == 120 and tide.select("tide").distinct().count() >= 1
    r = steps.reproject(t.withColumns({"x": F.lit(500000.0) + F.col("x"), "y": F.lit(5e6) + F.col("y")}), "epsg:32760", "epsg:4326", smooth=5)
    assert all(abs(p.x - 177) < 0.1 for p in r.select("x").collect())


def test_misties_of_crossing_lines(spark):
    base = np.sin(np.arange(200) / 6) * np.exp(-(((np.arange(200) - 90) / 25) ** 2))
    rows = []
    for k, shift in enumerate((0, 4, -3)):
        s = np.roll(base, shift).tolist()
        for t in range(11):
            x, y = (10.0 * t, 50.0 + 0.1 * t) if k == 0 else (30.0 * k + 0.1 * t, 10.0 * t + 0.05)
            rows.append((f"l{k}", t, x, y, s))
    t = spark.createDataFrame(rows, "line string, tracl int, x double, y double, samples array<double>")
    shifts = {r.line: r["shift"] for r in steps.misties(t, 10.0).collect()}
    assert shifts["l1"] - shifts["l0"] == -4 or shifts["l1"] - shifts["l0"] == 4
    fixed = steps.correct_misties(t, spark.createDataFrame(list(shifts.items()), "line string, shift int"))
    peaks = {r.line: int(np.argmax(r.samples)) for r in fixed.where("tracl = 0").collect()}
    assert max(peaks.values()) - min(peaks.values()) <= 2


def test_merge_step(spark):
    rows = [("a", 1, 1, 10, [1.0, 2.0]), ("a", 2, 2, 20, [3.0, 4.0]), ("b", 2, 1, 20, [3.0, 4.0]), ("b", 5, 2, 51, [5.0, 6.0])]
    t = spark.createDataFrame(rows, "file string, tracl int, tracr int, fldr int, samples array<double>")
    groups = spark.createDataFrame([("a", "l"), ("b", "l")], "file string, line string")
    m = steps.merge(t, groups, ["fldr"]).orderBy("tracl").collect()
    assert [(r.tracl, r.fldr, r.samples, r.tracr) for r in m] == [(1, 10, [1.0, 2.0], 1), (2, 20, [3.0, 4.0], 2), (3, 30, [0.0, 0.0], 3), (4, 40, [0.0, 0.0], 4), (5, 51, [5.0, 6.0], 5)]
    f = spark.createDataFrame([("f1", 10), ("f2", 5_000_000), ("f3", 5_000_000), ("f4", 10)], "file string, size long")
    assert [r.files for r in merging.files_to_merge(f).orderBy("island").collect()] == [["f1", "f2"], ["f3", "f4"]]


def test_delay_one_trace_off(spark):
    rows = []
    for t in range(1, 31):
        s = np.zeros(200)
        s[40 if t <= 16 else 140] = 5.0  # the record changes one trace after the header
        rows.append(("l", t, 10.0 if t <= 15 else 20.0, s.tolist()))
    t = spark.createDataFrame(rows, "line string, tracl int, delrt double, samples array<double>")
    assert [(r.tracl, r.delrt_new) for r in delays.correct_delays(t, n_samples=40).collect()] == [(16, 10.0)]
    assert steps.correct_delays(t, n_samples=40).where("tracl = 16").first()["delrt"] == 10.0
    assert windows.segments(t, ["line"], ["tracl"], "delrt").select("segment").distinct().count() == 2


def test_headers(spark):
    lines_ = [headers.prefixed(i + 1, "") for i in range(40)]
    df = spark.createDataFrame([(lines_,)], "l array<string>")
    t = df.withColumn("l", headers.set_title(F.col("l"))).withColumn("l", headers.add_info(F.col("l"), "PAD (1)", "2024-01-01")).withColumn("l", headers.add_info(F.col("l"), "TIDE", "2024-01-01"))
    out = t.first()["l"]
    assert all(len(x) == 80 for x in out) and headers.TITLE in out[24] and out[25].rstrip() == "C26 2024-01-01: PAD (1)  TIDE"
    assert len(t.select(headers.history(F.col("l")).alias("h")).first()["h"]) == 1


def test_correlate_and_tables(spark, tmp_path):
    d = tmp_path / "aux"
    d.mkdir()
    (d / "L1_a_UTM60S_x.nav").write_text("tracl,tracr,fldr,x,y\n1,1,1,2.5,3.5\n")
    r = tables.read_auxiliary(spark, str(d), "nav").collect()
    assert [(x.line, x.tracl, x.x) for x in r] == [("L1_a", 1, 2.5)]
    tables.export_coordinates(survey(spark), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 36
    x = joins.intersections(joins.segments(spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 10.0, 10.0), ("b", 1, 0.0, 10.0), ("b", 2, 10.0, 0.0)], "line string, tracl int, x double, y double")), 3.0)
    assert [(p.x, p.y) for p in x.collect()] == [(5.0, 5.0)]
    tables.intersections_report(x, str(tmp_path / "x"))
    assert lines.bad_traces_mixed(survey(spark)).count() == 36


def test_streams(spark, tmp_path):
    t = survey(spark).withColumns({"amp": F.get("samples", F.lit(32)), "time": F.to_timestamp(F.lit("2024-01-01 00:00:00"))}).select("line", "tracl", "x", "y", "amp", "time")
    t.write.parquet(str(tmp_path / "in"))
    stream = arrivals.traces(spark, str(tmp_path / "in"), "line string, tracl int, x double, y double, amp double, time timestamp")
    m = geometry.coords_to_bins(-5, 115, -5, 25, 10, 10)
    q = arrivals.running_fold(stream, m).writeStream.format("memory").queryName("fold").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(fold) from fold").first()[0] == 36
    q = arrivals.arrivals_per_window(stream).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from counts").first()[0] >= 36


def test_command_line(spark, tmp_path):
    import json

    from echogrid.plans import cli

    t = survey(spark)
    d = t.select(F.concat("line", F.lit("_UTM60S.sgy")).alias("file"), F.col("tracl").alias("trace"), "tracl", F.lit(-100).alias("scalco"), F.lit(1).alias("counit"), F.rint(F.col("x") * 100).cast("int").alias("sx"), F.rint(F.col("y") * 100).cast("int").alias("sy"), F.lit(50).alias("dt"), "samples")
    segy.write(d, str(tmp_path / "segy"))
    at = lambda n: str(tmp_path / f"{n}.parquet")
    cli.run(spark, ["09", str(tmp_path / "segy"), at("t")])
    cli.run(spark, ["04", at("t"), at("p")])
    cli.run(spark, ["08", at("p"), at("d"), "--window_time", "0.5", "--dt", "0.05"])
    (tmp_path / "cube.json").write_text(json.dumps({"extent": [-5, 115, -5, 25], "bin_size": [10, 10], "twt_limits": [0, 3.2], "dt": 0.05}))
    cli.run(spark, ["10", at("d"), at("c"), "--params_cube_setup", str(tmp_path / "cube.json")])
    cli.run(spark, ["11", at("c"), at("g"), "--dt", "0.05", "--gain", "tpow=1", "--balance"])
    cli.run(spark, ["12", at("g"), at("f"), "--dt", "0.05", "--compute_real"])
    (tmp_path / "pocs.json").write_text(json.dumps({"fold": at("c"), "niter": 4}))
    cli.run(spark, ["13", at("f"), at("i"), "--path_pocs_parameter", str(tmp_path / "pocs.json")])
    cli.run(spark, ["14", at("i"), at("b"), "--dt", "0.05", "--compute_real"])
    cli.run(spark, ["15", at("i"), at("s"), "--smooth", "median"])
    cube = spark.read.parquet(at("b")).join(spark.read.parquet(at("c")).select("il", "xl", "x", "y"), ["il", "xl"])
    cube.write.parquet(at("x"))
    cli.run(spark, ["16", at("x"), str(tmp_path / "out"), "--dt", "0.05"])
    assert segy.read(spark, str(tmp_path / "out")).count() == 36
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["08", "a", "b"])


def segy_files(spark, t, path, **more):
    d = t.select(F.concat("line", F.lit("_UTM60S.sgy")).alias("file"), F.col("tracl").alias("trace"), "tracl", F.lit(-100).alias("scalco"), F.lit(1).alias("counit"), F.rint(F.col("x") * 100).cast("int").alias("sx"), F.rint(F.col("y") * 100).cast("int").alias("sy"), F.rint("delrt").cast("int").alias("delrt"), F.lit(50).alias("dt"), *[v.alias(k) for k, v in more.items()], "samples")
    segy.write(d, path)
    return path


def test_segy_parts_and_unequal_traces(spark, tmp_path, monkeypatch):
    whole = segy_files(spark, survey(spark), str(tmp_path / "a"))
    want = sorted(map(str, segy.read(spark, whole, fields="all").collect()))
    reader = lambda **o: segy.SegyReader({"path": whole, "fields": "all", **o})
    rows = lambda r: sorted(str(x) for p in r.partitions() for b in r.read(p) for x in b.to_pylist())
    one = rows(reader())
    assert len(one) == len(want) == 36
    for split, batch in ((700, 1), (5000, 900), (1 << 30, 1 << 20)):
        monkeypatch.setattr(segy, "SPLIT_BYTES", split)
        monkeypatch.setattr(segy, "BATCH_BYTES", batch)
        assert rows(reader()) == one
    monkeypatch.setattr(segy, "SKIP_BYTES", 100)
    heads = [x for p in reader(samples="false").partitions() for b in reader(samples="false").read(p) for x in b.to_pylist()]
    assert len(heads) == 36 and all(x["samples"] is None for x in heads) and {x["tracl"] for x in heads} == set(range(1, 13))
    # traces that differ in length are read one by one, by the first part alone
    monkeypatch.setattr(segy, "SPLIT_BYTES", 700)
    (tmp_path / "b").mkdir()
    data = segy.file_head("", 4, 50, 2) + segy.encode_trace({"tracl": 1, "ns": 4}, np.ones(4)) + segy.encode_trace({"tracl": 2, "ns": 7}, np.ones(7))
    (tmp_path / "b" / "u.sgy").write_bytes(data)
    r = segy.SegyReader({"path": str(tmp_path / "b")})
    assert len(r.partitions()) > 1 and [(x["tracl"], len(x["samples"])) for p in r.partitions() for b in r.read(p) for x in b.to_pylist()] == [(1, 4), (2, 7)]
    (tmp_path / "b" / "u.sgy").write_bytes(data[:3700])
    assert [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()] == []


def test_options_of_line_steps(spark, tmp_path):
    from echogrid.plans import cli

    ns = 200
    rows = []
    for k in range(2):
        for t in range(40):
            s = 0.01 * np.sin(np.arange(ns))
            s[100 + t % 2 : 106 + t % 2] = 3.0
            rows.append((f"l{k}", t + 1, 500000.0 + 10 * t, 5e6 + 10.0 * k, 2.0, 0.05, s.tolist()))
    t = spark.createDataFrame(rows, "line string, tracl int, x double, y double, delrt double, dt double, samples array<double>")
    d = t.select(F.concat("line", F.lit("_UTM60S_raw.sgy")).alias("file"), F.col("tracl").alias("trace"), "tracl", F.lit(1).alias("scalco"), F.lit(1).alias("counit"), F.col("x").cast("int").alias("sx"), F.col("y").cast("int").alias("sy"), F.col("delrt").cast("int").alias("delrt"), F.lit(50).alias("dt"), (F.lit(1000) + F.col("tracl") % 2).alias("swdep"), F.lit(-10).alias("scalel"), F.lit(2020).alias("year"), F.lit(100).alias("day"), "samples")
    segy.write(d, str(tmp_path / "in"))
    segy.write(d.withColumn("file", F.lit("l9_UTM60S_other.sgy")), str(tmp_path / "in"))
    at = lambda n: str(tmp_path / n)
    raw = ["--filename_suffix", "raw"]
    cli.run(spark, ["09", at("in"), at("t.parquet"), *raw])
    assert spark.read.parquet(at("t.parquet")).count() == 80
    cli.run(spark, ["05", at("in"), at("static"), *raw, "--segy", "--txt_suffix", "static", "--win_samples", "20", "--nsta", "3", "--nlta", "30", "--win_median", "5", "--n_amp_samples", "3", "--use_delay", "--limit_shift", "--limit_depressions", "5", "5", "5", "--write_seafloor2trace", "--write_aux"])
    s = segy.read(spark, at("static"), fields="tracl,static_field,seafloor_field,delrt,sx,dt")
    assert s.count() == 80 and s.where("static_field = -1000 and seafloor_field > 2000 and dt = 50 and delrt = 2 and sx >= 500000").count() == 80
    assert {r.file.rpartition("/")[2] for r in s.select("file").distinct().collect()} == {"l0_UTM60S_raw_static.sgy", "l1_UTM60S_raw_static.sgy"}
    assert "CORRECT STATICS" in segy.text_headers(spark, at("static")).first()["text"] and spark.read.csv(at("static.aux"), header=True).count() == 80
    cli.run(spark, ["05", at("in"), at("deep.parquet"), *raw, "--mode", "swdep"])
    deep = spark.read.parquet(at("deep.parquet"))
    assert deep.count() == 80 and {r.pick for r in deep.select("pick").distinct().collect()} == {100.0, 100.1}
    shallow = steps.correct_statics(t.withColumns({"swdep": F.when(F.col("line") == "l0", 0).otherwise(F.lit(100)), "scalel": F.lit(1)}), mode="swdep")
    assert shallow.where("line = 'l0' and static = 0").count() == 40
    with pytest.raises(ValueError):
        steps.correct_statics(t, mode="x")
    cli.run(spark, ["04", at("in"), at("pad"), *raw, "--segy", "--byte_delay", "109"])
    assert segy.read(spark, at("pad")).count() == 80
    cli.run(spark, ["02", at("in"), at("geo"), *raw, "--segy", "--crs_src", "epsg:32760", "--crs_dst", "epsg:4326", "--scalar_coords", "-1000", "--dst_coords", "CDP"])
    assert segy.read(spark, at("geo"), fields="scalco,cdp_x").where("scalco = -1000 and abs(cdp_x - 177000) < 100").count() == 80
    cli.run(spark, ["06", at("in"), at("tide.parquet"), *raw, "--constituents", "m2:1.0:0.0", "--write_aux"])
    assert spark.read.csv(at("tide.parquet") + ".aux", header=True).columns == ["line", "tracl", "tracr", "fldr", "time", "tide", "tide_samples"]
    (tmp_path / "nav").mkdir()
    (tmp_path / "nav" / "l0_UTM60S.nav").write_text("tracl,tracr,fldr,x,y\n" + "".join(f"{k},1,1,{7 * k},3\n" for k in range(1, 41)))
    cli.run(spark, ["07", at("in"), at("tie.parquet"), *raw, "--coords_origin", "aux", "--coords_path", at("nav"), "--win_cc", "2", "9", "--cell", "20", "--write_QC", "--write_aux"])
    tie = spark.read.parquet(at("tie.parquet"))
    assert tie.count() == 80 and tie.where("line = 'l0' and x = 7 * tracl").count() == 40 and tie.where("line = 'l1' and x >= 500000").count() == 40
    for step, bad in (("05", ["--mode", "x"]), ("16", []), ("04", ["--byte_delay", "2"])):
        with pytest.raises(SystemExit):
            cli.parser().parse_args([step, "a", "b", *bad])


def test_options_of_cube_steps(spark, tmp_path):
    import json

    from echogrid.plans import cli

    at = lambda n: str(tmp_path / n)
    survey(spark).write.parquet(at("t.parquet"))
    (tmp_path / "cube.json").write_text(json.dumps({"extent": [-5, 115, -5, 25], "bin_size": [5, 5], "twt_limits": [0, 3.2], "dt": 0.05}))
    cli.run(spark, ["10", at("t.parquet"), at("c.parquet"), "--params_cube_setup", at("cube.json"), "--attribute", "env", "--bin_size", "10", "10", "--dtype_data", "float32", "--stacking_method", "idw", "--write_aux"])
    c = spark.read.parquet(at("c.parquet"))
    assert c.count() == 36 and c.schema["samples"].dataType.simpleString() == "array<float>" and spark.read.csv(at("c.parquet") + ".aux", header=True).count() == 36
    for extra, has in (([], False), (["--store_ref_amp"], True)):
        cli.run(spark, ["11", at("c.parquet"), at(f"p{has}.parquet"), "--dt", "0.05", "--balance", *extra])
        assert ("reference" in spark.read.parquet(at(f"p{has}.parquet")).columns) is has
    cli.run(spark, ["12", at("c.parquet"), at("f.parquet"), "--dt", "0.05", "--compute_real"])
    (tmp_path / "pocs.json").write_text(json.dumps({"fold": at("c.parquet"), "niter": 3}))
    cli.run(spark, ["13", at("f.parquet"), at("i.parquet"), "--path_pocs_parameter", at("pocs.json")])
    cli.run(spark, ["14", at("i.parquet"), at("b.parquet"), "--dt", "0.05", "--compute_real", "--rescale-envelope"])
    ends = spark.read.parquet(at("b.parquet")).agg(F.min(F.array_min("samples")), F.max(F.array_max("samples"))).first()
    assert tuple(ends) == (0.0, 1.0)
    # every second inline is there: amplitudes that are linear in the inline are filled exactly
    lin = [(il, xl, [il * 2.0 + xl + k for k in range(8)]) for il in range(1, 14, 2) for xl in range(1, 10)]
    cube = spark.createDataFrame(lin, "il int, xl int, samples array<double>")
    for method in ("linear", "slinear", "nearest", "cubic", "polynomial"):
        up = steps.upsample(cube, method, dealias=False)
        assert up.count() == 13 * 9 and {r.il for r in up.select("il").distinct().collect()} == set(range(1, 14))
        if method != "nearest":
            assert all(np.allclose(r.samples, [r.il * 2.0 + r.xl + k for k in range(8)]) for r in up.collect())
    with pytest.raises(ValueError):
        steps.upsample(cube, "x")
    assert steps.step_of(cube, "il") == 2 and steps.upsample(up).count() == 13 * 9
    cube.write.parquet(at("sparse.parquet"))
    cli.run(spark, ["15", at("sparse.parquet"), at("up.parquet"), "--upsample", "--spatial-dealiasing"])
    damped = spark.read.parquet(at("up.parquet"))
    assert damped.count() == 13 * 9 and all(len(r.samples) == 8 for r in damped.collect())
    cli.run(spark, ["15", at("sparse.parquet"), at("us.parquet"), "--upsample", "cubic", "--remove-footprint", "--bin-size", "5", "10", "--footprint-sigma", "1", "--buffer-filter", "1"])
    assert spark.read.parquet(at("us.parquet")).count() == 8
    cli.run(spark, ["15", at("b.parquet"), at("agc.parquet"), "--agc", "--agc-win", "0.00025", "--dt", "0.05", "--agc-kind", "mean"])
    from echogrid.kernels import dsp

    plain = {(r.il, r.xl): np.array(r.samples) for r in spark.read.parquet(at("b.parquet")).collect()}
    assert all(np.allclose(r.samples, dsp.agc(plain[r.il, r.xl][None], 5, "mean")[0]) for r in spark.read.parquet(at("agc.parquet")).collect())
    for kind in ("profile", "profile-iline", "profile-xline"):
        cli.run(spark, ["15", at("b.parquet"), at(f"{kind}.parquet"), "--remove-footprint", kind, "--footprint-sigma", "1"])
        assert spark.read.parquet(at(f"{kind}.parquet")).count() == 36
    for bad in (["--agc"], ["--smooth", "nope"]):
        with pytest.raises(SystemExit):
            cli.run(spark, ["15", at("b.parquet"), at("no.parquet"), *bad])
    with pytest.raises(ValueError):
        steps.postprocess(cube, footprint={}, agc={"win": 3})
    assert steps.footprint_direction(5, 5) == "both" and steps.footprint_direction(5, 10) == "iline"
    placed = spark.read.parquet(at("b.parquet")).join(c.select("il", "xl", "x", "y"), ["il", "xl"])
    placed.write.parquet(at("x.parquet"))
    cli.run(spark, ["16", at("x.parquet"), at("out"), "--dt", "0.05", "--inlines_per_file", "2"])
    back = segy.read(spark, at("out"), fields="cdp,iline,scalco,cdp_x")
    assert {r.file.rpartition("/")[2]: r.n for r in back.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"cube_il000001.sgy": 24, "cube_il000003.sgy": 12}
    assert {r.scalco for r in back.collect()} == {-1000} and sorted(r.cdp for r in back.collect()) == list(range(1, 37))


def test_outliers_of_every_kind(spark):
    from echogrid.kernels import dsp
    from echogrid.operators import outliers

    x = [float(v) for v in 3 * np.sin(np.arange(40) / 5)]
    x[17] += 50
    d = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "line int, k int, a double")
    for kind in outliers.KINDS:
        got = [r.a for r in outliers.replaced(d, ["line"], ["k"], "a", "r_z-score", kind, 11).orderBy("k").collect()]
        assert len(got) == 40 and abs(got[17] - 3 * np.sin(17 / 5)) < 2 and got[5] == x[5]
    flagged = [r.k for r in outliers.moving_zscore(d, ["line"], ["k"], "a").where("outlier").collect()]
    z = np.abs(np.array(x) - dsp.smooth(np.array(x), 11)) / np.std(x)
    assert 17 in flagged and sorted(flagged) == np.flatnonzero(z > 1).tolist() and outliers.moving_zscore(d.limit(3), ["line"], ["k"], "a").where("outlier").count() == 0
    with pytest.raises(ValueError):
        outliers.interpolated(d.withColumn("outlier", F.lit(False)), ["line"], ["k"], "a", kind="x")


def test_full_header_is_not_lost(spark):
    full = spark.createDataFrame([([headers.prefixed(i + 1, "x" * 77) for i in range(40)],)], "l array<string>")
    with pytest.raises(Exception, match="full"):
        full.select(headers.add_info(F.col("l"), "PAD", "2024-01-01")).collect()
    # a line of the same prefix before the title is not written to; the second one behind it that has room is
    lines_ = [headers.prefixed(i + 1) for i in range(40)]
    lines_[3], lines_[25], lines_[26] = headers.prefixed(4, " 2024-01-01: A"), headers.prefixed(26, " 2024-01-01: " + "y" * 60), headers.prefixed(27, " 2024-01-01: B")
    out = spark.createDataFrame([(lines_,)], "l array<string>").select(headers.add_info(F.col("l"), "TIDE TIDE", "2024-01-01").alias("l")).first()["l"]
    assert out[26].rstrip() == "C27 2024-01-01: B  TIDE TIDE" and out[3] == lines_[3] and out[25] == lines_[25]


def test_stacking_methods_agree_with_arrays(spark):
    from echogrid.operators import binning

    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(1, 4)), int(rng.integers(1, 3)), float(d), rng.normal(size=6).tolist()) for d in [0.0, *rng.uniform(0, 2, 60)]]
    t = spark.createDataFrame(rows, "il int, xl int, dist double, samples array<double>").repartition(5)
    bins = spark.createDataFrame([(i, j) for i in range(1, 5) for j in range(1, 3)], "il int, xl int")
    for method in binning.METHODS:
        got = {(r.il, r.xl): (r.fold, np.array(r.samples)) for r in binning.stack_traces(t, bins, 6, method, 2.0).collect()}
        assert len(got) == 8 and got[4, 1][0] == 0 and not got[4, 1][1].any()
        for key in {(i, j) for i, j, _, _ in rows}:
            own = [(d, np.array(s)) for i, j, d, s in rows if (i, j) == key]
            w = np.array([1 / max(d, 1e-9) ** 2.0 for d, _ in own])
            x = np.array([s for _, s in own])
            want = {"average": x.mean(axis=0), "median": np.median(x, axis=0), "nearest": min(own, key=lambda p: p[0])[1], "idw": (w[:, None] * x).sum(axis=0) / w.sum()}[method]
            assert got[key][0] == len(own) and np.allclose(got[key][1], want)


def test_shifts_of_a_network(spark):
    """Conjugate gradients against the least-norm solution: two networks, repeated crossings, poor ones, one of a line with itself."""
    r = np.random.default_rng(7)
    rows = [(f"a{i}", f"a{j}", int(r.integers(-9, 9)), float(r.uniform(0.5, 1))) for i in range(12) for j in range(i) if r.random() < 0.4 for _ in range(1 + i % 2)]
    rows += [("b0", "b1", 5, -0.9), ("b1", "b2", -2, 0.8), ("a0", "b0", 99, 0.1), ("a3", "a3", 7, 1.0), ("b1", "b2", None, 1.0)]
    pairs = spark.createDataFrame(rows, "line_a string, line_b string, lag int, r double")
    good = [x for x in rows if abs(x[3]) >= 0.5 and x[2] is not None and x[0] != x[1]]
    names = sorted({x[0] for x in good} | {x[1] for x in good})
    m, v = np.zeros((len(good), len(names))), np.array([x[2] for x in good], float)
    for k, x in enumerate(good):
        m[k, names.index(x[0])], m[k, names.index(x[1])] = 1, -1
    want = np.linalg.lstsq(m, v, rcond=None)[0]
    got = {x.line: x for x in lines.solved_shifts(pairs).collect()}
    assert sorted(got) == names and np.allclose([got[n].offset for n in names], want, atol=1e-7)
    left = v - m @ want
    for k, n in enumerate(names):
        own = m[:, k] != 0
        assert got[n].n == own.sum() and got[n].rms == pytest.approx(np.sqrt((left[own] ** 2).mean()), abs=1e-6)
    res = lines.residuals(pairs.where("abs(r) >= 0.5 AND lag IS NOT NULL AND line_a <> line_b"), lines.solved_shifts(pairs)).collect()
    assert sorted(round(x.residual, 6) + 0 for x in res) == pytest.approx(sorted(left), abs=1e-5)
    assert lines.line_shifts(pairs.where("r > 2")).collect() == []


def test_nearest_vertices_by_cells(spark):
    """Dense and sparse lines, targets far away, ties, lines without vertices, odd coordinates."""
    r = np.random.default_rng(8)
    points = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 100, (300, 2)))] + [("b", 5, 0.0, 0.0), ("b", 3, 2.0, 0.0), ("b", 9, None, 1.0)]
    targets = [(k, "a", float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-3000, 3000, (60, 2)))] + [(100 + k, "a", float(x), float(y)) for k, (x, y) in enumerate(r.uniform(0, 100, (60, 2)))]
    targets += [(200, "b", 1.0, 0.0), (201, "b", 1e6, -1e6), (202, "none", 0.0, 0.0), (203, "b", None, 0.0), (204, "b", float("nan"), 0.0)]
    p = spark.createDataFrame(points, "line string, tracl int, x double, y double")
    t = spark.createDataFrame(targets, "id int, own string, x double, y double")
    got = {x.id: x for x in joins.nearest_vertex(p, t, "own").collect()}
    assert set(got) == {x[0] for x in targets[:-3]}
    for k, line, x, y in targets[:-3]:
        d, n = min((np.hypot(px - x, py - y), i) for q, i, px, py in points if q == line and px is not None)
        assert got[k].nearest == n and got[k].dist == pytest.approx(d)
    assert got[200].nearest == 3
    assert joins.nearest_vertex(p, t.where("own = 'none'"), "own").collect() == []


def test_nearest_vertices_with_ties_by_rounded_distance(spark):
    """Distances equal to six decimals are ties, in other cells and beyond the first cell's side too."""
    p = spark.createDataFrame([("a", 2, 1.0, 0.0), ("a", 1, -1.0 - 1e-8, 0.0), ("a", 3, 50.0, 0.0)], "line string, tracl int, x double, y double")
    t = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "a", 49.0, 0.0)], "id int, own string, x double, y double")
    for cell in (None, 1.0, 0.3):
        got = {x.id: (x.nearest, x.dist) for x in joins.nearest_vertex(p, t, "own", cell=cell, digits=6).collect()}
        assert got == {0: (1, 1.0), 1: (3, 1.0)}
        assert {x.id: x.nearest for x in joins.nearest_vertex(p, t, "own", cell=cell).collect()} == {0: 2, 1: 3}


def test_conditions_on_intersections_stay_out_of_the_join(spark):
    """Callers ask for finite x and y, t and u for the ends: repeated in the join's condition, the JVM wouldn't compile it."""
    lines = [(k, i, float(k + 3 * (i % 2)), float(5 * i)) for k in range(6) for i in range(4)]
    x = joins.intersections(joins.segments(spark.createDataFrame(lines, "line long, tracl int, x double, y double")), 20.0)
    plan = x.where("x - x = 0 AND y - y = 0")._jdf.queryExecution().optimizedPlan().toString()
    join = next(row for row in plan.splitlines() if "Join Inner" in row)
    assert "/" not in join and "*" not in join


def test_short_lines_meet_their_targets_whole(spark, monkeypatch):
    """Lines of few vertices as arrays, and with longer ones in the same call, as by cells alone; ties go to the smaller number."""
    r = np.random.default_rng(9)
    points = [(n, i, float(x), float(y)) for n, size in (("a", 40), ("b", 5), ("c", 12)) for i, (x, y) in enumerate(r.integers(0, 9, (size, 2)))]
    points += [("b", 7, 2.5, None), (None, 1, 0.0, 0.0)]
    targets = [(k, n, float(x), float(y)) for k, (n, (x, y)) in enumerate(zip("abcd" * 20, r.integers(-3, 12, (80, 2)), strict=True))] + [(99, "b", None, 0.0), (98, None, 0.0, 0.0)]
    p = spark.createDataFrame(points, "line string, tracl int, x double, y double")
    t = spark.createDataFrame(targets, "id int, own string, x double, y double")
    for digits in (None, 6):
        want = sorted(map(tuple, joins.nearest_vertex(p, t, "own", cell=2.0, digits=digits).collect()))
        assert len(want) == 60
        for short in (64, 20, 0):
            monkeypatch.setattr(joins, "SHORT", short)
            assert sorted(map(tuple, joins.nearest_vertex(p, t, "own", digits=digits).collect())) == want
    n = spark.createDataFrame([(x,) for x in (0.0, 0.49999999999999994, 0.5, 1.5, 2.4999999999999996, 1e300)], "d double")
    assert all(x[0] == x[1] for x in n.select(joins._tied(F.col("d"), 0), F.round("d", 0)).collect())


def test_interpolation_goes_on_where_it_stopped(spark, tmp_path):
    """Finished batches stay as they are, a half-written one and missing ones are made; the whole equals one run."""
    import os

    from echogrid.operators import pocs

    r = np.random.default_rng(3)
    mask = (r.random(48) > 0.4).astype(int).tolist()
    rows = [(k, 6, 8, (r.normal(size=48) * mask).tolist()) for k in range(7)]
    slices = spark.createDataFrame(rows, "slice long, n_il int, n_xl int, grid array<double>")
    path = str(tmp_path / "run")
    first = pocs.resume(slices.where("slice < 4"), mask, path, size=2, niter=5)
    assert {x.attempt for x in first.collect()} == {1}
    kept = {f: os.stat(f"{path}/batch=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/batch=0")}
    os.remove(f"{path}/batch=1/_SUCCESS")
    got = {x.slice: x for x in pocs.resume(slices, mask, path, size=2, niter=5).collect()}
    want = {x.slice: x for x in pocs.interpolate(slices, mask, niter=5).collect()}
    assert kept == {f: os.stat(f"{path}/batch=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/batch=0")}
    assert set(got) == set(want) and all(got[k].grid == want[k].grid and got[k].niter == want[k].niter for k in want)
    assert {k: got[k].attempt for k in got} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2}
    m = pocs.run_metrics(pocs.resume(slices, mask, path, size=2, niter=5)).collect()
    assert [(x.attempt, x.slices) for x in m] == [(1, 2), (2, 5)] and m[0].iterations == got[0].niter + got[1].niter
