"""Projections and datum shifts at published points, and parsing."""

import pytest
from pyspark.sql import functions as F

from echogrid.functions import crs, projections


def dms(d, m=0, s=0.0):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


FT = 1200 / 3937
#: system, longitude, latitude, easting, northing as published (to 1 cm), of the system's own datum
POINTS = [
    (f"+proj=lcc +lat_1={dms(28, 23)} +lat_2={dms(30, 17)} +lat_0={dms(27, 50)} +lon_0=-99 +x_0={2000000 * FT} +y_0=0 +ellps=clrk66 +units=us-ft", -96.0, 28.5, 2963503.91, 254759.80),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", dms(-76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51),
    ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82),
    ("+proj=merc +lat_ts=42 +lon_0=51 +ellps=krass", 53.0, 53.0, 165704.29, 5171848.07),
    ("epsg:32661", 44.0, 73.0, 3320416.75, 632668.43),
    ("epsg:3032", 120.0, -75.0, 7255380.79, 7053389.56),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50),
    ("epsg:3857", dms(-100, 20), dms(24, 22, 54.433), -11169055.58, 2800000.00),
]


@pytest.mark.parametrize("system, lon, lat, x, y", POINTS)
def test_published_points(spark, system, lon, lat, x, y):
    s = projections.parse(system)
    there = projections.project(s, F.lit(lon), F.lit(lat))
    back = projections.unproject(s, *there)
    r = spark.range(1).select(*[c.alias(n) for n, c in zip("xyab", (*there, *back), strict=True)]).first()
    assert abs(r.x - x) < 0.011 and abs(r.y - y) < 0.011
    assert abs(r.a - lon) < 1e-9 and abs(r.b - lat) < 1e-9


def test_seven_parameters(spark):
    """The published example of a shift by position vectors: to 0.0005 seconds of arc, and back."""
    x, y = crs.transform(F.lit(4.0), F.lit(55.0), "epsg:4322", "epsg:4326")
    back = crs.transform(x, y, "epsg:4326", "epsg:4322")
    r = spark.range(1).select(x.alias("x"), y.alias("y"), back[0].alias("a"), back[1].alias("b")).first()
    assert abs(r.x - dms(4, 0, 0.554)) < 0.0005 / 3600 and abs(r.y - dms(55, 0, 0.090)) < 0.0005 / 3600
    assert abs(r.a - 4) < 1e-9 and abs(r.b - 55) < 1e-9


def test_conic_of_the_south_and_ends(spark):
    """A cone that opens to the south, longitudes across 180 degrees, the poles."""
    df = spark.createDataFrame([(174.5, -41.3), (-179.9, -45.0), (179.9, -35.0), (0.0, -89.9)], "lon double, lat double")
    for system in ("epsg:3851", "epsg:3031", "epsg:2193", "epsg:3395", "epsg:32661"):
        d = df.where("lat > -60") if system != "epsg:3031" else df
        x, y = crs.transform(F.col("lon"), F.col("lat"), "epsg:4326", system)
        a, b = crs.transform(F.col("x"), F.col("y"), system, "epsg:4326")
        for r in d.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", a.alias("a"), b.alias("b")).collect():
            assert abs((r.a - r.lon + 180) % 360 - 180) < 1e-8 and abs(r.b - r.lat) < 1e-8
    pole = spark.range(1).select(*[c.alias(n) for n, c in zip("xy", crs.transform(F.lit(33.0), F.lit(-90.0), "epsg:4326", "epsg:3031"), strict=True)]).first()
    assert abs(pole.x) < 1e-3 and abs(pole.y) < 1e-3


def test_general_systems_agree_with_utm(spark):
    x, y = crs.transform(F.lit(172.3), F.lit(-43.2), "epsg:4326", "epsg:32759")
    u, v = projections.transform(F.lit(172.3), F.lit(-43.2), "epsg:4326", "+proj=utm +zone=59 +south +ellps=WGS84")
    r = spark.range(1).select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).first()
    assert abs(r.x - r.u) < 1e-4 and abs(r.y - r.v) < 1e-4


def test_wkt():
    text = 'PROJCS["X",GEOGCS["G",DATUM["D",SPHEROID["Clarke 1866",6378206.4,294.978698213898],TOWGS84[1,2,3,0,0,0,0]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",28.3833333],PARAMETER["standard_parallel_2",30.2833333],PARAMETER["latitude_of_origin",27.8333333],PARAMETER["central_meridian",-99],PARAMETER["false_easting",2000000],PARAMETER["false_northing",0],UNIT["US survey foot",0.304800609601219]]'
    s = projections.parse(text)
    assert (s.kind, s.a, s.shift[:3], s.unit) == ("lcc", 6378206.4, (1.0, 2.0, 3.0), 0.304800609601219)
    assert s.value("x_0") == pytest.approx(2000000 * FT) and s.value("lat_2") == 30.2833333
    polar = projections.parse('PROJCS["P",GEOGCS["G",DATUM["D",SPHEROID["W",6378137,298.257223563]],UNIT["degree",0.017]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",-71],PARAMETER["central_meridian",0],UNIT["metre",1]]')
    assert (polar.value("lat_0"), polar.value("lat_ts"), polar.unit) == (-90, -71, 1)
    assert projections.parse('GEOGCS["G",DATUM["D",SPHEROID["W",6378137,298.257223563]]]').kind == "longlat"
    for bad in ("epsg:1", "+proj=omerc", "+proj=stere +lat_0=50", "+proj=longlat +ellps=unheard", "PROJCS[]", "+proj=lcc", "+proj=longlat +towgs84=1,2"):
        with pytest.raises(ValueError):
            projections.parse(bad)


def test_arrow_batches_equal_columns(spark):
    """Round trips on arrays, as columns give them; a null coordinate gives nulls; formulas are no interpreted lambdas."""
    systems = ["epsg:3857", "epsg:3395", "epsg:3031", "epsg:3851", "epsg:2193", "+proj=utm +zone=60 +south +ellps=intl +towgs84=59.47,-5.04,187.44,0.47,-0.1,1.024,-4.5993"]
    d = spark.createDataFrame([(171.5, -44.25), (179.75, -41.0), (None, 3.0)], "lon double, lat double")
    there = projections.transformed(F.col("lon"), F.col("lat"), [("epsg:4326", s) for s in systems])
    back = projections.transformed(F.col("lon"), F.col("lat"), [("epsg:4326", s, "epsg:4326") for s in systems])
    got = d.select("lon", "lat", there.alias("there"), back.alias("back")).collect()
    for k, s in enumerate(systems):
        x, y = crs.transform(F.col("lon"), F.col("lat"), "epsg:4326", s)
        for row, want in zip(got, d.select(x.alias("x"), y.alias("y")).collect(), strict=True):
            if row.lon is None:
                assert tuple(row.there[k]) == tuple(row.back[k]) == (None, None)
            else:
                assert tuple(row.there[k]) == pytest.approx(tuple(want), abs=1e-6)
                assert tuple(row.back[k]) == pytest.approx((row.lon, row.lat), abs=1e-8)
    from echogrid.plans import queries

    plan = queries.QUERIES["b22_round_trips"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lambda" not in plan
