"""Gridded tides against plain sums and known properties of the constituents."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from echogrid.operators import delays, tides
from echogrid.plans import steps


def test_speeds_are_those_of_the_constituents(spark):
    """The argument's growth in an hour is the constituent's speed."""
    t = spark.createDataFrame([("2021-03-04 05:06:07", "2021-03-04 06:06:07")], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    a, b = tides.longitudes(F.col("a")), tides.longitudes(F.col("b"))
    got = t.select(*[(tides.argument(n, b) - tides.argument(n, a)).alias(n) for n in delays.SPEEDS]).first()
    assert all(got[n] == pytest.approx(v, abs=2e-5) for n, v in delays.SPEEDS.items())


def plain(points, raster, names, lat, lon, when, minor):
    hc = {}
    y, x = (lat - raster.lat) / raster.step_lat, (lon - raster.lon) % 360 / raster.step_lon
    iy, ix = math.floor(y), math.floor(x)
    for n in names:
        total, weight = 0, 0
        for dy in (0, 1):
            for dx in (0, 1):
                v = points.get((n, iy + dy, (ix + dx) % raster.around))
                w = abs(1 - dy - (y - iy)) * abs(1 - dx - (x - ix))
                if v is not None:
                    total, weight = total + w * v[0] * complex(math.cos(math.radians(v[1])), -math.sin(math.radians(v[1]))), weight + w
        if not weight:
            return None
        hc[n] = total / weight
    if minor:
        hc |= {n: sum(w * hc[m] for m, w in of.items()) for n, of in tides.MINOR.items() if n not in hc and set(of) <= set(hc)}
    mjd = when.timestamp() / 86400 + 40587
    at = {"t": mjd % 1 * 360, **{k: a + b * (mjd - tides.EPOCH_MJD) for k, (a, b) in tides.LONGITUDES.items()}}
    out = 0
    for n, c in hc.items():
        t, s, h, p, pp, more = tides.ARGUMENTS[n]
        angle = t * at["t"] + s * at["s"] + h * at["h"] + p * at["p"] + pp * tides.SOLAR_PERIGEE + more
        of, power = tides.NODAL_OF.get(n, (n, 1))
        a, b, u = tides.NODAL.get(of, (1.0, 0.0, 0.0))
        node = math.radians(at["n"])
        z = complex(math.cos(math.radians(angle + u * power * math.sin(node))), math.sin(math.radians(angle + u * power * math.sin(node))))
        out += (a + b * math.cos(node)) ** power * (c * z).real
    return out


@pytest.mark.parametrize("minor", [False, True])
def test_grid(spark, tmp_path, minor):
    """Between raster points, on them, beside land, on land, and across the full circle."""
    names = ["k1", "m2", "m4", "n2", "o1", "q1", "s2"]
    raster = tides.Raster(-40.0, 0.0, 2.0, 2.0)
    points = {(n, iy, ix): (0.2 + 0.1 * k + 0.01 * iy, float(30 * k + 5 * ix + iy)) for k, n in enumerate(names) for iy in range(5) for ix in (0, 1, 2, 3, 178, 179) if (iy, ix) not in ((1, 1), (3, 2), (3, 3), (4, 2), (4, 3))}
    rows = [(n.upper(), raster.lat + iy * 2, raster.lon + ix * 2, a, g) for (n, iy, ix), (a, g) in points.items()]
    rows += [("M2", -38.0, 2.0, None, None), *[(n, raster.lat, raster.lon + 2 * ix, None, None) for n in names for ix in range(180)]]
    spark.createDataFrame(rows, "constituent string, lat double, lon double, amplitude double, phase double").write.parquet(str(tmp_path / "m"))
    model, found, known = tides.read_model(spark, str(tmp_path / "m"))
    assert known == names and (found.lat, found.lon, found.step_lat) == (-40.0, 0.0, 2.0)
    model = tides.cells(spark.read.parquet(str(tmp_path / "m")).where("amplitude IS NOT NULL"), raster, names)
    when = datetime(2021, 7, 3, 4, 5, 6, tzinfo=timezone.utc)
    places = [(-39.3, 1.2), (-38.0, 2.0), (-37.1, 2.9), (-36.0, 4.0), (-33.0, 5.0), (-38.6, 359.0), (-38.6, -1.0), (10.0, 100.0)]
    df = spark.createDataFrame([(i, lat, lon, when) for i, (lat, lon) in enumerate(places)], "id int, lat double, lon double, time timestamp")
    got = {r.id: r.tide for r in tides.predict(df, model, raster, names, minor).collect()}
    for i, (lat, lon) in enumerate(places):
        want = plain(points, raster, names, lat, lon, when, minor)
        assert got[i] is None if want is None else got[i] == pytest.approx(want, abs=1e-9)
    assert got[7] is None and got[5] == pytest.approx(got[6])


def test_step_with_a_model(spark, tmp_path):
    rows = [(n, lat / 2, lon / 2, 1.0, 10.0 * k) for k, n in enumerate(("m2", "k1")) for lat in range(-90, -60) for lon in range(330, 372)]
    path = str(tmp_path / "model")
    spark.createDataFrame(rows, "constituent string, lat double, lon double, amplitude double, phase double").write.parquet(path)
    when = datetime(2021, 7, 3, 4, 5, 6, tzinfo=timezone.utc)
    t = spark.createDataFrame([("l", k, 700000.0 + 10 * (k // 2), 5300000.0, 0.05, when, [float(i) for i in range(64)]) for k in range(4)], "line string, tracl int, x double, y double, dt double, time timestamp, samples array<double>")
    got = steps.compensate_tide(t, src="epsg:32760", model_dir=path, correct_minor=True).select("tracl", "tide", "lat", "lon").collect()
    assert len(got) == 4 and all(abs(r.tide) < 2.5 and r.tide != 0 for r in got)
    with pytest.raises(ValueError, match="lacks"):
        steps.compensate_tide(t, model_dir=path, names=["s2"])
    with pytest.raises(ValueError, match="no arguments"):
        tides.cells(t, tides.Raster(0, 0, 1, 1), ["zz9"])
