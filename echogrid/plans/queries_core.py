"""Queries of categories A to D: scans, columns, joins, stacking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import layouts
from ..functions import amplitudes, crs, headers, projections, units
from ..operators import binning, delays, geometry, joins, lines, merging, tides, windows
from . import adapters as a
from .registry import query, r, rounded

# --- A: scans, sources, sinks


@query("a3_trace_headers", "SELECT o_orderkey AS tracl, o_custkey AS fldr, c_nationkey AS counit, -100 AS scalco, round(o_totalprice * 100, 0)::BIGINT AS sx FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    j = a.table(s, d, "orders").join(a.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("tracl"), F.col("o_custkey").alias("fldr"), F.col("c_nationkey").alias("counit"), F.lit(-100).alias("scalco"), F.round(F.col("o_totalprice") * 100, 0).cast("long").alias("sx"))


@query(
    "a4_header_scrape",
    a.with_("nav") + "SELECT line, tracl, (x - 0)::DOUBLE AS x, y, 0.05::DOUBLE AS dt, round(64 * 0.05::DOUBLE + (tracl % 3) * 0.2::DOUBLE, 6) AS twt_max FROM nav WHERE rint_x BETWEEN 1 AND 20".replace("rint_x", "round_even(x / 100, 0)"),
)
def _(s, d):
    n = a.nav(s, d)
    bins = s.range(1, 21).select(F.col("id").cast("int").alias("il"))
    n = n.withColumn("il", F.rint(F.col("x") / 100).cast("int")).join(bins, "il")
    return n.select("line", "tracl", "x", "y", F.lit(0.05).alias("dt"), r(64 * F.lit(0.05) + F.col("tracl") % 3 * F.lit(0.2)).alias("twt_max"))


@query("a5_header_differences", "SELECT key, count(DISTINCT value) AS n_values FROM (SELECT c_custkey AS file, 'nation' AS key, c_nationkey AS value FROM customer UNION ALL SELECT c_custkey, 'format', 5 FROM customer) GROUP BY key HAVING count(DISTINCT value) > 1")
def _(s, d):
    c = a.table(s, d, "customer").select(F.col("c_custkey").alias("file"), F.explode(F.create_map(F.lit("nation"), F.col("c_nationkey"), F.lit("format"), F.lit(5))).alias("key", "value"))
    return binning.header_differences(c)


@query("a6_include_files", "SELECT doc_id, source, lang FROM documents WHERE contains(source, '1') AND lang = 'en'")
def _(s, d):
    return a.table(s, d, "documents").where(F.contains("source", F.lit("1")) & (F.col("lang") == "en")).select("doc_id", "source", "lang")


@query("a9_set_coordinates", a.with_("nav") + "SELECT o_orderkey, round_even(x * 100, 0)::INT AS sx, round_even(y * 100, 0)::INT AS sy, 1 AS counit, -100 AS scalco FROM nav")
def _(s, d):
    u = lambda c: units.unscale_coordinate(F.col(c), F.lit(-100))
    return a.nav(s, d).select("o_orderkey", u("x").alias("sx"), u("y").alias("sy"), F.lit(1).alias("counit"), F.lit(-100).alias("scalco"))


_FILE = "concat('/data/', o_orderstatus, '_', o_custkey, '_UTM60S_', o_orderkey, '.nav')"


@query("a10_line_of_file", "SELECT o_orderkey, concat(o_orderstatus, '_', o_custkey) AS line FROM orders")
def _(s, d):
    return a.table(s, d, "orders").withColumn("file", F.expr(_FILE)).select("o_orderkey", headers.line_of_file(F.col("file")).alias("line"))


@query("a11_auxiliary_lines", "SELECT concat(o_orderstatus, '_', o_custkey) AS line, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    o = a.table(s, d, "orders").withColumn("file", F.expr(_FILE))
    return o.select(headers.line_of_file(F.col("file")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query("a12_export_coords", a.with_("nav") + "SELECT o.o_orderkey, printf('%.2f', o_totalprice) AS x, printf('%.2f', y) AS y FROM nav JOIN orders o USING (o_orderkey)")
def _(s, d):
    text = lambda c: headers.coordinate_text(F.col(c), 1)
    n = a.nav(s, d).select("o_orderkey", text("y").alias("y"))
    return a.table(s, d, "orders").select("o_orderkey", text("o_totalprice").alias("x")).join(n, "o_orderkey")


@query("a13_navigation", a.with_("nav") + "SELECT line, tracl, round_even(x * 100, 0) / 100 AS x, round_even(y * 100, 0) / 100 AS y FROM nav")
def _(s, d):
    h = a.nav(s, d).select("line", "tracl", F.rint(F.col("x") * 100).cast("int").alias("sx"), F.rint(F.col("y") * 100).cast("int").alias("sy"))
    u = lambda c: units.scale_coordinate(F.col(c), F.lit(-100), F.lit(1))
    return h.select("line", "tracl", u("sx").alias("x"), u("sy").alias("y"))


@query(
    "a14_bad_traces",
    a.with_("traces", "samples")
    + """, st AS (SELECT line, tracl, (avg(amp) - min(amp)) / (max(amp) - min(amp)) > 0.5 AS bad FROM samples GROUP BY line, tracl),
m AS (SELECT b.line, b.tracl, s.i, avg(s.amp) AS mixed FROM st b JOIN samples s ON s.line = b.line AND s.tracl IN (b.tracl - 1, b.tracl + 1) WHERE b.bad GROUP BY b.line, b.tracl, s.i)
SELECT s.line, s.tracl, s.i, round(coalesce(mixed, amp), 6) + 0 AS amp FROM samples s LEFT JOIN m ON m.line = s.line AND m.tracl = s.tracl AND m.i = s.i""",
)
def _(s, d):
    t = lines.bad_traces_mixed(a.traces(s, d).select("line", "tracl", "samples"), limit=0.5)
    return rounded(layouts.to_samples(t).select("line", "tracl", "i", "amp"), "amp")


@query("a16_coverage", a.with_("cube") + "SELECT count(*) AS n_bins, sum(fold)::BIGINT AS n_filled, round(sum(fold) * 100.0 / count(*), 2)::DOUBLE AS percent FROM cube")
def _(s, d):
    return binning.coverage(a.cube(s, d))


@query("a17_slice_major", a.with_("cube", more="c AS (SELECT il, xl, unnest(range(len(s)))::INT AS i, unnest(s) AS amp FROM cube)") + "SELECT i AS slice, il, xl, amp FROM c")
def _(s, d):
    c = a.cube(s, d)
    long = layouts.to_samples(c).select("il", "xl", "i", "amp")
    back = layouts.from_slices(layouts.to_slices(long, *a.extent(c)))
    return back.join(long.select("il", "xl").distinct(), ["il", "xl"], "left_semi").select("slice", "il", "xl", "amp")


@query("a19_cube_headers", a.with_("cube") + "SELECT row_number() OVER (ORDER BY il, xl)::INT AS cdp, il AS iline, xl AS xline, fold FROM cube")
def _(s, d):
    c = a.cube(s, d)
    # cdp counts bins in inline order: bins of earlier inlines, then the place in its own
    n = c.groupBy("il").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("il").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = c.join(before, "il").withColumn("cdp", (F.col("before") + F.row_number().over(Window.partitionBy("il").orderBy("xl"))).cast("int"))
    return j.select("cdp", F.col("il").alias("iline"), F.col("xl").alias("xline"), "fold")


@query("a20_batch_names", a.with_("traces", "samples") + "SELECT i // 10 AS b, printf('cube_%06.3f_%06.3f.nc', min(i) * 0.05, max(i) * 0.05) AS name FROM samples GROUP BY i // 10")
def _(s, d):
    b = layouts.batches(layouts.to_samples(a.traces(s, d)).select(F.col("i").alias("slice")), 10)
    return b.groupBy(F.col("batch").cast("long").alias("b")).agg(layouts.batch_name("cube", F.min("slice") * F.lit(0.05), F.max("slice") * F.lit(0.05)).alias("name"))


@query("a21_split_complex", a.with_("traces", "samples") + "SELECT line, tracl, i, amp AS re, -amp AS im FROM samples")
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(layouts.join_complex(F.col("samples"), F.transform("samples", lambda x: -x))).alias("i", "v"))
    return t.select("line", "tracl", "i", "v.re", "v.im")


@query("a24_batches", "SELECT event_id, (event_id // 20)::INT AS batch FROM events")
def _(s, d):
    return layouts.batches(a.table(s, d, "events"), 20, "event_id").select("event_id", "batch")


# --- B: columns


@query(
    "b1_scale_coordinates",
    "SELECT o_orderkey, CASE WHEN k = 0 THEN o_custkey::DOUBLE WHEN k = 1 THEN o_custkey / 100 WHEN k = 2 THEN o_custkey * 10.0::DOUBLE ELSE o_custkey / 3600000 END AS x FROM (SELECT *, o_orderkey % 4 AS k FROM orders)",
)
def _(s, d):
    k = F.col("o_orderkey") % 4
    scalar = F.when(k == 1, -100).when(k == 2, 10).otherwise(0)
    x = units.scale_coordinate(F.col("o_custkey"), scalar, F.when(k == 3, 2).otherwise(1))
    return a.table(s, d, "orders").select("o_orderkey", x.alias("x"))


@query("b2_unscale_coordinates", "SELECT o_orderkey, round_even(o_totalprice * 10, 0)::INT AS x FROM orders")
def _(s, d):
    return a.table(s, d, "orders").select("o_orderkey", units.unscale_coordinate(F.col("o_totalprice"), F.lit(-10)).alias("x"))


@query("b3_coordinate_scalar", "SELECT o_orderkey, (-pow(10, 9 - length(floor(o_totalprice)::BIGINT::VARCHAR)))::BIGINT AS scalar, pow(10, 9 - length(floor(o_totalprice)::BIGINT::VARCHAR)) AS multiplier FROM orders")
def _(s, d):
    o = a.table(s, d, "orders").select("o_orderkey", units.auto_scalar(F.col("o_totalprice")).alias("scalar"))
    return o.withColumn("multiplier", units.scalar_multiplier(F.col("scalar")))


@query(
    "b4_units",
    """SELECT event_id, round(value / 750, 6) AS depth2twt, round(value * 0.001 * 750, 6) AS twt2depth, round(value / (0.05 * 0.001), 6) AS twt2samples,
round(value * 0.05, 6) AS samples2twt, round(value / 750 / (0.05 * 0.001), 6) AS depth2samples, round(value * 0.05 * 0.001 * 750, 6) AS samples2depth FROM events""".replace("0.001", "0.001::DOUBLE").replace("0.05", "0.05::DOUBLE"),
)
def _(s, d):
    v = F.col("value")
    return a.table(s, d, "events").select(
        "event_id", F.round(units.depth2twt(v), 6).alias("depth2twt"), F.round(units.twt2depth(v, units="ms"), 6).alias("twt2depth"), F.round(units.twt2samples(v, 0.05, "ms"), 6).alias("twt2samples"),
        F.round(units.samples2twt(v, 0.05), 6).alias("samples2twt"), F.round(units.depth2samples(v, 0.05, units="ms"), 6).alias("depth2samples"), F.round(units.samples2depth(v, 0.05, units="ms"), 6).alias("samples2depth"),
    )


@query("b10_convert_twt", "SELECT event_id, round(value * 1e3, 4) AS s_ms, round(value * 1e-3, 6) AS us_ms, round(value * 1e3, 4) AS us_ns, value AS ms_ms FROM events")
def _(s, d):
    c = lambda x, y: units.convert_twt(F.col("value"), x, y)
    return a.table(s, d, "events").select("event_id", F.round(c("s", "ms"), 4).alias("s_ms"), F.round(c("us", "ms"), 6).alias("us_ms"), F.round(c("us", "ns"), 4).alias("us_ns"), c("ms", "ms").alias("ms_ms"))


@query("b11_round_to_multiple", "SELECT o_orderkey, round_even(o_totalprice / 10, 0) * 10 AS nearest, ceil(o_totalprice / 25) * 25 AS up, floor(o_totalprice / 25) * 25 AS down FROM orders")
def _(s, d):
    c = lambda m, k: units.round_to_multiple(F.col("o_totalprice"), m, k)
    return a.table(s, d, "orders").select("o_orderkey", c(10, "nearest").alias("nearest"), c(25, "up").alias("up"), c(25, "down").alias("down"))


@query("b12_rescale", "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS v FROM events WINDOW w AS (PARTITION BY event_type)")
def _(s, d):
    w = Window.partitionBy("event_type")
    return a.table(s, d, "events").select("event_id", r(units.rescale(F.col("value"), F.min("value").over(w), F.max("value").over(w))).alias("v"))


@query("b13_rescale_global", "SELECT event_id, round(-1 + (value - lo) * 3 / (hi - lo), 6) + 0 AS v FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def _(s, d):
    e = a.table(s, d, "events")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.crossJoin(F.broadcast(ends)).select("event_id", r(units.rescale(F.col("value"), F.col("lo"), F.col("hi"), -1, 2)).alias("v"))


_Z = "list_transform(s, lambda x: CASE WHEN x < 0 THEN 0 ELSE x END)"


@query("b14_valid_slice", a.with_("traces", more=f"z AS (SELECT line, tracl, {_Z} AS z FROM traces), f AS (SELECT *, list_position(list_transform(z, lambda x: x <> 0), true) AS p FROM z)") + "SELECT line, tracl, z[p:p+9] AS v FROM f".replace("z[p:p+9] AS v", "len(z[p:p+9])::INT AS n, round(list_sum(z[p:p+9]), 6) AS v"))
def _(s, d):
    z = a.traces(s, d).withColumn("z", F.transform("samples", lambda x: F.when(x < 0, 0.0).otherwise(x)))
    v = z.withColumn("v", amplitudes.valid_slice(F.col("z"), 10))
    return v.select("line", "tracl", F.size("v").alias("n"), r(amplitudes.total(F.col("v"))).alias("v"))


@query(
    "b15_pad_mirrored",
    a.with_("traces")
    + """SELECT line, tracl, unnest(range(70))::INT AS i, round(unnest(list_concat(list_concat([s[1] - abs(s[4] - s[1]), s[1] - abs(s[3] - s[1]), s[1] - abs(s[2] - s[1])], s),
[s[64] - abs(s[63] - s[64]), s[64] - abs(s[62] - s[64]), s[64] - abs(s[61] - s[64])])), 6) + 0 AS amp FROM traces""",
)
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.mirrored(F.col("samples"), 3)).alias("i", "amp"))
    return rounded(t, "amp")


@query("b16_pad_zeros", a.with_("traces") + "SELECT line, tracl, unnest(range(68))::INT AS i, unnest(list_concat(list_concat([0.0::DOUBLE, 0], s), [0.0::DOUBLE, 0])) AS amp FROM traces")
def _(s, d):
    return a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.padded(F.col("samples"), 2, 2)).alias("i", "amp"))


@query("b17_consecutive_distance", a.with_("nav") + "SELECT line, tracl, round(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 6) AS step FROM nav WINDOW w AS (PARTITION BY line ORDER BY tracl)")
def _(s, d):
    return geometry.consecutive_distance(a.nav(s, d), ["line"], ["tracl"]).select("line", "tracl", r("step").alias("step"))


@query("b19_distance", a.with_("points") + "SELECT line, tracl, price, round(sqrt((x - 25) * (x - 25) + (y - 4) * (y - 4)), 6) AS dist FROM points")
def _(s, d):
    return a.points(s, d).select("line", "tracl", "price", r(geometry.distance(F.col("x"), F.col("y"), F.lit(25.0), F.lit(4.0))).alias("dist"))


@query("b20_snap_extent", "SELECT o_orderkey, round_even(o_totalprice / 7 + 1e-9, 0)::INT AS low, round_even(o_totalprice / 7 - 1e-9, 0)::INT AS high FROM orders")
def _(s, d):
    x = F.col("o_totalprice") / 7
    return a.table(s, d, "orders").select("o_orderkey", units.snap_inside(x, True).alias("low"), units.snap_inside(x, False).alias("high"))


@query("b21_dms2dd", "SELECT o_orderkey, round(d + m / 60 + (s + h / 100) / 3600, 9) AS dd FROM (SELECT o_orderkey, o_orderkey % 180 AS d, o_orderkey % 60 AS m, o_custkey % 60 AS s, o_custkey % 100 AS h FROM orders)")
def _(s, d):
    k = a.table(s, d, "orders").select("o_orderkey", F.format_string("%03d%02d%02d%02d", F.col("o_orderkey") % 180, F.col("o_orderkey") % 60, F.col("o_custkey") % 60, F.col("o_custkey") % 100).alias("dms"))
    return k.select("o_orderkey", r(units.dms2dd(F.col("dms")), 9).alias("dd"))


def _utm_sql(lon: str, lat: str, centre: int) -> tuple[str, str]:
    """Easting and northing on the southern hemisphere by Krueger's series in the third flattening n, to its fourth power."""
    n = 1 / (2 * 298.257223563 - 1)
    size = 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    p, d = f"radians({lat})", f"radians({lon} - {centre})"
    t = f"sinh(atanh(sin({p})) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin({p})))"
    xi, eta = f"atan2({t}, cos({d}))", f"asinh(sin({d}) / sqrt({t} * {t} + cos({d}) * cos({d})))"
    x = " + ".join([eta, *(f"{c!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(terms, 1))])
    y = " + ".join([xi, *(f"{c!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(terms, 1))])
    put = lambda z: z.replace("* xi)", f"* {xi})").replace("* eta)", f"* {eta})")
    return f"500000 + {size!r}::DOUBLE * ({put(x)})", f"10000000 + {size!r}::DOUBLE * ({put(y)})"


_EAST, _NORTH = _utm_sql("(171 + x / 1000.0::DOUBLE)", "(-44 + y / 1000.0::DOUBLE)", 177)


@query("b22_reproject", a.with_("nav") + f"SELECT o_orderkey, round({_EAST}, 3) + 0 AS easting, round({_NORTH}, 3) + 0 AS northing, 0.0::DOUBLE AS error FROM nav")
def _(s, d):
    n = a.nav(s, d)
    lon, lat = F.lit(171.0) + F.col("x") / 1000, F.lit(-44.0) + F.col("y") / 1000
    x, y = crs.transform(lon, lat, "epsg:4326", "epsg:32760")
    back = crs.transform(x, y, "epsg:32760", "epsg:4326")
    return n.select("o_orderkey", r(x, 3).alias("easting"), r(y, 3).alias("northing"), r(F.abs(back[0] - lon) + F.abs(back[1] - lat), 7).alias("error"))


_LCC = "+proj=lcc +lat_1=-37.5 +lat_2=-44.5 +lat_0=-41 +lon_0=173 +x_0=3000000 +y_0=7000000 +ellps=GRS80"
_SYSTEMS = ("epsg:3857", "epsg:3395", "epsg:3031", _LCC, "epsg:2193", "+proj=utm +zone=60 +south +ellps=intl +towgs84=59.47,-5.04,187.44,0.47,-0.1,1.024,-4.5993")


@query("b22_round_trips", a.with_("nav") + f"SELECT o_orderkey, i::INT AS system, round(171 + x / 1000, 7) + 0 AS lon, round(-44 + y / 1000, 7) + 0 AS lat FROM nav, range({len(_SYSTEMS)}) t(i)")
def _(s, d):
    """Longitude and latitude to each system and back: Mercator, polar, conic, transverse, another datum."""
    n = a.nav(s, d)
    lon, lat = F.lit(171.0) + F.col("x") / 1000, F.lit(-44.0) + F.col("y") / 1000
    trips = projections.transformed(lon, lat, [("epsg:4326", c, "epsg:4326") for c in _SYSTEMS])
    e = n.select("o_orderkey", F.posexplode(trips).alias("system", "p"))
    return e.select("o_orderkey", "system", r("p.x", 7).alias("lon"), r("p.y", 7).alias("lat"))


def _lcc_sql() -> str:
    p = projections.parse(_LCC)
    n, scale, origin = projections._conic(p)
    e = p.e2**0.5
    phi = "radians(-44 + y / 1000)"
    t = f"tan(pi() / 4 - {phi} / 2) / pow((1 - {e!r}::DOUBLE * sin({phi})) / (1 + {e!r}::DOUBLE * sin({phi})), {e / 2!r}::DOUBLE)"
    rho, theta = f"{scale!r}::DOUBLE * pow({t}, {n!r}::DOUBLE)", f"{n!r}::DOUBLE * radians(171 + x / 1000 - 173)"
    return f"round(3000000 + {rho} * sin({theta}), 3) + 0 AS easting, round(7000000 + {origin!r}::DOUBLE - {rho} * cos({theta}), 3) + 0 AS northing"


@query("b22_lambert", a.with_("nav") + f"SELECT o_orderkey, {_lcc_sql()} FROM nav")
def _(s, d):
    n = a.nav(s, d)
    x, y = crs.transform(F.lit(171.0) + F.col("x") / 1000, F.lit(-44.0) + F.col("y") / 1000, "epsg:4326", "epsg:3851")
    return n.select("o_orderkey", r(x, 3).alias("easting"), r(y, 3).alias("northing"))


@query("b23_agc_samples", "SELECT p_partkey, (n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END)::INT AS n FROM (SELECT p_partkey, floor(round(p_size * 0.1::DOUBLE / 0.05::DOUBLE, 9))::INT AS n FROM part)")
def _(s, d):
    return a.table(s, d, "part").select("p_partkey", units.agc_samples(F.col("p_size") * F.lit(0.1), F.lit(0.05)).alias("n"))


@query("b24_resampled_twt", "SELECT p_partkey, round(p_size * 0.05::DOUBLE * 64 / 40 + p_partkey % 7, 6) AS twt FROM part")
def _(s, d):
    return a.table(s, d, "part").select("p_partkey", r(units.resampled_twt(F.col("p_size"), (F.col("p_partkey") % 7).cast("double"), F.lit(0.05), F.lit(64), F.lit(40))).alias("twt"))


@query("b25_tide_times", "SELECT event_id, (make_date(2020, 1, 1) + (event_id % 366)::INT)::TIMESTAMP + to_seconds(3600 * (event_id % 24) + 60 * (event_id % 60) + event_id % 59) AS time FROM events")
def _(s, d):
    e = F.col("event_id")
    return a.table(s, d, "events").select("event_id", delays.timestamp(F.lit(2020), e % 366 + 1, e % 24, e % 60, e % 59).cast("timestamp_ntz").alias("time"))


@query(
    "b25_tide_distinct",
    "WITH u AS (SELECT user_id % 50 AS lat, user_id % 7 AS lon, min(floor(epoch(ts))::BIGINT) AS t FROM events GROUP BY 1, 2) SELECT event_id, round(1.5 * cos(radians((t / 3600.0::DOUBLE * 28.9841042::DOUBLE) % 360 - 30)), 4) + 0 AS tide FROM events JOIN u ON user_id % 50 = lat AND user_id % 7 = lon",
)
def _(s, d):
    e = a.table(s, d, "events").withColumns({"lat": F.col("user_id") % 50, "lon": F.col("user_id") % 7})
    tide = lambda p: p.withColumn("tide", delays.harmonic_tide(F.col("time"), {"m2": (1.5, 30.0)}))
    return delays.at_distinct(e, ["lat", "lon"], F.col("ts"), tide).select("event_id", r("tide", 4).alias("tide"))


_TIDES = ["k1", "m2"]
_TIDE_CELLS = "cell AS (SELECT DISTINCT (c_custkey % 11)::INT AS iy, (c_custkey // 11 % 15)::INT AS ix FROM customer WHERE c_custkey % 13 > 0)"


def _tide_sql() -> str:
    """The same sum in SQL, from the tables of arguments and corrections."""
    out = []
    for n in _TIDES:
        t, *rest, pp, more = tides.ARGUMENTS[n]
        angle = " + ".join([f"{t} * 360.0::DOUBLE * (mjd - floor(mjd))", *[f"{k} * ({a}::DOUBLE + {b}::DOUBLE * (mjd - {tides.EPOCH_MJD}::DOUBLE))" for k, (a, b) in zip(rest, [tides.LONGITUDES[x] for x in "shp"], strict=True)], repr(float(pp * tides.SOLAR_PERIGEE + more))])
        a, b = tides.LONGITUDES["n"]
        f0, f1, u = tides.NODAL[n]
        node = f"radians({a}::DOUBLE + {b}::DOUBLE * (mjd - {tides.EPOCH_MJD}::DOUBLE))"
        v = f"radians({angle} + {u}::DOUBLE * sin({node}))"
        out.append(f"({f0}::DOUBLE + {f1}::DOUBLE * cos({node})) * (re_{n} * cos({v}) - im_{n} * sin({v}))")
    return " + ".join(out)


@query(
    "b25_tide_grid",
    f"""WITH {_TIDE_CELLS}, hc AS (SELECT iy, ix, {", ".join(f"(0.5::DOUBLE + {k} * 0.3::DOUBLE + (iy + ix) % 5 * 0.1::DOUBLE) * cos(radians(iy * 20 + ix * 7 + {k} * 50)) AS re_{n}, -(0.5::DOUBLE + {k} * 0.3::DOUBLE + (iy + ix) % 5 * 0.1::DOUBLE) * sin(radians(iy * 20 + ix * 7 + {k} * 50)) AS im_{n}" for k, n in enumerate(_TIDES))} FROM cell),
e AS (SELECT event_id, floor(epoch(ts)) / 86400.0::DOUBLE + 40587.0::DOUBLE AS mjd, user_id % 40 / 8.0::DOUBLE AS y, user_id % 56 / 4.0::DOUBLE AS x FROM events),
c AS (SELECT *, floor(y)::INT + dy AS iy, floor(x)::INT + dx AS ix, abs(1 - dy - (y - floor(y))) * abs(1 - dx - (x - floor(x))) AS w FROM e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(dy, dx)),
m AS (SELECT event_id, any_value(mjd) AS mjd, {", ".join(f"sum(w * {p}_{n}) / nullif(sum(w) FILTER ({p}_{n} IS NOT NULL), 0) AS {p}_{n}" for n in _TIDES for p in ("re", "im"))} FROM c LEFT JOIN hc USING (iy, ix) GROUP BY event_id)
SELECT event_id, round({_tide_sql()}, 4) + 0 AS tide FROM m""",
)
def _(s, d):
    """Places of events on a raster of customers' numbers, some of it land."""
    key = F.col("c_custkey")
    cell = a.table(s, d, "customer").where(key % 13 > 0).select((key % 11).alias("iy"), (F.floor(key / 11) % 15).alias("ix")).distinct()
    raster = tides.Raster(10.0, 20.0, 0.5, 0.25)
    points = cell.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("constituent"), F.lit(k).alias("k")) for k, n in enumerate(_TIDES)])))
    points = points.select("c.constituent", (raster.lat + F.col("iy") * raster.step_lat).alias("lat"), (raster.lon + F.col("ix") * raster.step_lon).alias("lon"), (0.5 + F.col("c.k") * 0.3 + (F.col("iy") + F.col("ix")) % 5 * 0.1).alias("amplitude"), (F.col("iy") * 20 + F.col("ix") * 7 + F.col("c.k") * 50).cast("double").alias("phase"))
    u = F.col("user_id")
    places = a.table(s, d, "events").select("event_id", (raster.lat + u % 40 / 8.0 * raster.step_lat).alias("lat"), (raster.lon + u % 56 / 4.0 * raster.step_lon).alias("lon"), F.col("ts").alias("time"))
    return tides.predict(places, tides.cells(points, raster, _TIDES), raster, _TIDES).select("event_id", r("tide", 4).alias("tide"))


# --- C: joins


@query("c1_nearest_regular", a.with_("points") + "SELECT line, tracl, price, greatest(0, least(9, round_even((x - 1) / 5.0::DOUBLE, 0)))::INT AS k FROM points")
def _(s, d):
    return a.points(s, d).select("line", "tracl", "price", joins.nearest_regular(F.col("x"), 1, 5, 10).alias("k"))


@query(
    "c1_nearest_join",
    a.with_("points", more="ref AS (SELECT DISTINCT p_size::DOUBLE AS v FROM part), m AS (SELECT p.line, p.tracl, p.price, v, row_number() OVER (PARTITION BY p.line, p.tracl ORDER BY abs(x - v), v) AS r FROM points p, ref)") + "SELECT line, tracl, price, v AS nearest FROM m WHERE r = 1",
)
def _(s, d):
    ref = a.table(s, d, "part").select(F.col("p_size").cast("double").alias("v"))
    return joins.nearest_join(a.points(s, d), "x", ref, "v").select("line", "tracl", "price", "nearest")


@query("c2_nearest_twt", "SELECT event_id, arg_min(i, (abs(t - x), i)) AS i FROM (SELECT event_id, value % 3.15 AS x FROM events) e, (SELECT i, i * 0.05::DOUBLE AS t FROM range(64) r(i)) GROUP BY event_id".replace("value % 3.15", "value % 3"))
def _(s, d):
    i = joins.nearest_regular(F.col("value") % 3, 0.0, 0.05, 64)
    e = a.table(s, d, "events").select("event_id", (F.col("value") % 3).alias("x"), i.alias("k"))
    # the axis is regular; its two neighbours decide ties by the smaller number
    t = lambda k: F.abs(k * F.lit(0.05) - F.col("x"))
    best = F.array_min(F.transform(F.filter(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1), lambda k: (k >= 0) & (k < 64)), lambda k: F.struct(t(k).alias("t"), k.alias("k"))))
    return e.select("event_id", best["k"].cast("long").alias("i"))


@query("c3_segments", a.with_("nav") + "SELECT * FROM (SELECT line, tracl AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM nav WINDOW w AS (PARTITION BY line ORDER BY tracl)) WHERE x1 IS NOT NULL")
def _(s, d):
    return joins.segments(a.nav(s, d))


_SEG = "seg AS (SELECT * FROM (SELECT line, tracl AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM tracks WINDOW w AS (PARTITION BY line ORDER BY tracl)) WHERE x1 IS NOT NULL)"
_CROSS = """x AS (SELECT a.line AS line_a, b.line AS line_b, a.seg AS seg_a, b.seg AS seg_b, a.x0, a.y0, a.x1 - a.x0 AS dx, a.y1 - a.y0 AS dy, b.x1 - b.x0 AS ex, b.y1 - b.y0 AS ey, b.x0 - a.x0 AS fx, b.y0 - a.y0 AS fy
FROM (SELECT *, line + unnest(range(1, 6)) AS other FROM seg) a JOIN seg b ON a.other = b.line),
tu AS (SELECT *, (fx * ey - fy * ex) / nullif(dx * ey - dy * ex, 0) AS t, (fx * dy - fy * dx) / nullif(dx * ey - dy * ex, 0) AS u FROM x),
cross_ AS (SELECT line_a, line_b, seg_a, seg_b, x0 + t * dx AS x, y0 + t * dy AS y FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query("c4_intersections", a.with_("tracks", more=f"{_SEG}, {_CROSS}") + "SELECT line_a, line_b, seg_a, seg_b, round(x, 4) AS x, round(y, 4) AS y FROM cross_")
def _(s, d):
    return rounded(joins.intersections(joins.segments(a.tracks(s, d)), 20.0), "x", "y", digits=4)


@query(
    "c5_nearest_vertices",
    a.with_("tracks", more=f"{_SEG}, {_CROSS}, m AS (SELECT c.*, n.tracl, sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)) AS d FROM cross_ c JOIN tracks n ON n.line = c.line_a)")
    + "SELECT line_a, line_b, seg_a, seg_b, arg_min(tracl, (round(d, 6), tracl)) AS nearest, round(min(d), 4) AS dist FROM m GROUP BY line_a, line_b, seg_a, seg_b",
)
def _(s, d):
    n = a.tracks(s, d)
    v = joins.nearest_vertex(n, joins.intersections(joins.segments(n), 20.0), "line_a", digits=6)
    return v.select("line_a", "line_b", "seg_a", "seg_b", "nearest", r("dist", 4).alias("dist"))


@query("c6_nearest_point", a.with_("points", more="m AS (SELECT line, tracl, (x - 20) * (x - 20) + (y - 3) * (y - 3) AS d FROM points)") + "SELECT line, arg_min(tracl, (d, tracl)) AS tracl, round(sqrt(min(d)), 6) AS dist FROM m GROUP BY line")
def _(s, d):
    p = a.points(s, d)
    dist = geometry.distance(F.col("x"), F.col("y"), F.lit(20.0), F.lit(3.0))
    m = p.groupBy("line").agg(F.min(F.struct(dist.alias("d"), "tracl")).alias("m"))
    return m.select("line", F.col("m")["tracl"].alias("tracl"), r(F.col("m")["d"]).alias("dist"))


@query("c7_lines_with_files", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def _(s, d):
    files = a.table(s, d, "customer").where("c_nationkey < 10").select(F.format_string("%d_UTM60S.sgy", "c_custkey").alias("file"))
    nav = a.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("line"))
    return joins.lines_with_files(nav, files).select("o_orderkey")


@query("c7_lines_without_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    c, o = a.table(s, d, "customer"), a.table(s, d, "orders").where("o_orderstatus = 'F'")  # files that are finished
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# --- D: aggregates, stacking


@query("d1_sampling_interval", "SELECT dt, count(*) AS n_lines FROM (SELECT user_id, min(round(value, 0)) AS dt FROM events GROUP BY user_id) GROUP BY dt")
def _(s, d):
    return binning.check_sampling(a.table(s, d, "events").select(F.col("user_id").alias("line"), F.round("value", 0).alias("dt")))


_BINS = "il_xl AS (SELECT *, round_even((y - 0) / 1.5::DOUBLE, 0)::INT + 1 AS il, round_even((x - 1) / 2.5::DOUBLE, 0)::INT + 1 AS xl FROM points), b AS (SELECT *, sqrt((x - ((xl - 1) * 2.5::DOUBLE + 1)) ** 2 + (y - (il - 1) * 1.5::DOUBLE) ** 2) AS dist FROM il_xl)"
_ALL = "grid AS (SELECT il::INT AS il, xl::INT AS xl FROM range(1, 8) a(il), range(1, 23) c(xl))"
#: Bins of 2.5 x 1.5 whose first centre is at (1, 0).
TRANSFORM = geometry.Affine(0, 1 / 1.5, 1, 1 / 2.5, 0, 1 - 1 / 2.5)


def _binned(s, d):
    p = a.points(s, d)
    p = p.withColumns({"il": F.rint((F.col("y") - 0) / F.lit(1.5)).cast("int") + 1, "xl": F.rint((F.col("x") - 1) / F.lit(2.5)).cast("int") + 1})
    return p.withColumn("dist", geometry.distance(F.col("x"), F.col("y"), (F.col("xl") - 1) * F.lit(2.5) + 1, (F.col("il") - 1) * F.lit(1.5)))


def _stacked(s, d, method, **more):
    bins = geometry.bins(s, 7, 22, TRANSFORM)
    c = binning.infill(bins.select("il", "xl"), binning.stack(_binned(s, d), method, **more))
    return c.select("il", "xl", r("amp").alias("amp"), "fold")


def _stack_sql(amp: str) -> str:
    return a.with_("points", more=f"{_BINS}, {_ALL}, g AS (SELECT il, xl, {amp} AS amp, count(*)::INT AS fold FROM b GROUP BY il, xl)") + "SELECT il, xl, round(coalesce(amp, 0), 6) + 0 AS amp, coalesce(fold, 0)::INT AS fold FROM grid LEFT JOIN g USING (il, xl)"


@query("d2_stack_average", _stack_sql("avg(amp)"))
def _(s, d):
    return _stacked(s, d, "average")


@query("d2_stack_median", _stack_sql("median(amp)"))
def _(s, d):
    return _stacked(s, d, "median")


@query("d2_stack_nearest", _stack_sql("arg_min(amp, (round(dist, 9), line, tracl))"))
def _(s, d):
    df = _binned(s, d).withColumn("dist", F.round("dist", 9))
    c = binning.infill(geometry.bins(s, 7, 22, TRANSFORM).select("il", "xl"), binning.stack(df, "nearest", ties=["line", "tracl"]))
    return c.select("il", "xl", r("amp").alias("amp"), "fold")


@query("d2_stack_idw", _stack_sql("sum(amp / greatest(dist, 1e-3)) / sum(1 / greatest(dist, 1e-3))"))
def _(s, d):
    df = _binned(s, d).withColumn("dist", F.greatest("dist", F.lit(1e-3)))
    c = binning.infill(geometry.bins(s, 7, 22, TRANSFORM).select("il", "xl"), binning.stack(df, "idw"))
    return c.select("il", "xl", r("amp").alias("amp"), "fold")


@query("d3_normalised_weights", a.with_("points", more=_BINS) + "SELECT il, xl, count(*) AS n, round(max(w), 9) AS top FROM (SELECT il, xl, (1 / greatest(dist, 1e-9)) / sum(1 / greatest(dist, 1e-9)) OVER (PARTITION BY il, xl) AS w FROM b) GROUP BY il, xl")
def _(s, d):
    w = binning.normalised_weights(_binned(s, d))
    return w.groupBy("il", "xl").agg(F.count("*").alias("n"), r(F.max("weight"), 9).alias("top"))


_RMS = "sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s))"


@query("d4_rms", a.with_("traces") + f"SELECT line, tracl, round({_RMS}, 6) AS rms FROM traces")
def _(s, d):
    return a.traces(s, d).select("line", "tracl", r(amplitudes.rms(F.col("samples"))).alias("rms"))


def _norm_sql(ref: str) -> str:
    return a.with_("traces", more=f"n AS (SELECT line, tracl, s, {ref} AS q FROM traces)") + "SELECT line, tracl, unnest(range(64))::INT AS i, round(unnest(list_transform(s, lambda x: x / q)), 6) + 0 AS amp FROM n"


def _balanced(s, d, kind):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.balance(F.col("samples"), kind)).alias("i", "amp"))
    return rounded(t, "amp")


@query("d5_rms_normalisation", _norm_sql(_RMS))
def _(s, d):
    return _balanced(s, d, "rms")


@query("d6_reference_amplitude", a.with_("traces") + f"SELECT line, tracl, round({_RMS}, 6) AS rms, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM traces")
def _(s, d):
    return a.traces(s, d).select("line", "tracl", r(amplitudes.reference(F.col("samples"), "rms")).alias("rms"), amplitudes.reference(F.col("samples"), "max").alias("peak"))


for _kind, _ref in (("peak", "list_max(list_transform(s, lambda x: abs(x)))"), ("mean", "list_avg(list_transform(s, lambda x: abs(x)))"), ("median", "list_median(list_transform(s, lambda x: abs(x)))")):
    query(f"d7_balance_{_kind}", _norm_sql(_ref))(lambda s, d, kind=_kind: _balanced(s, d, kind))


@query(
    "d7_balance_windowed",
    a.with_("traces", more="p AS (SELECT line, tracl, s, list_sum(list_transform(s, lambda x: x * x)) AS e FROM traces), w AS (SELECT line, tracl, s, sqrt(sum(e) OVER (PARTITION BY line ORDER BY tracl ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / (5 * 64)) AS q FROM p)")
    + "SELECT line, tracl, unnest(range(64))::INT AS i, round(unnest(list_transform(s, lambda x: x / q)), 6) + 0 AS amp FROM w",
)
def _(s, d):
    long = layouts.to_samples(a.traces(s, d)).select("line", "tracl", "i", "amp")
    b = windows.balance_windowed(long, "line", "tracl", "i", "amp", 5)
    return b.select("line", "tracl", "i", r("balanced").alias("amp"))


_NOISE = a.with_("traces", "samples", more="n AS (SELECT line, amp, round(amp, 1) AS m FROM samples)")


@query("d8_snr", _NOISE + "SELECT line, round(10 * log10(sum(amp * amp) / sum((amp - m) * (amp - m))), 6) AS snr FROM n GROUP BY line")
def _(s, d):
    x, n = F.col("amp"), F.round("amp", 1)
    t = layouts.to_samples(a.traces(s, d))
    return t.groupBy("line").agg(r(amplitudes.snr(x, n)).alias("snr"))


@query("d9_psnr", _NOISE + "SELECT line, round(10 * log10(1 / sqrt(avg((amp - m) * (amp - m)))), 6) AS psnr FROM n GROUP BY line")
def _(s, d):
    x, n = F.col("amp"), F.round("amp", 1)
    return layouts.to_samples(a.traces(s, d)).groupBy("line").agg(r(amplitudes.psnr(x, n)).alias("psnr"))


@query(
    "d10_noise_level",
    a.with_("cube", "grid", more="""q AS (SELECT i, il, xl, (amp - min(amp) OVER w) / (max(amp) OVER w - min(amp) OVER w) * 255 AS v FROM grid WINDOW w AS (PARTITION BY i)),
k AS (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 4 WHEN dy = 0 OR dx = 0 THEN -2 ELSE 1 END AS k FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
o AS (SELECT i, il + dy AS y, xl + dx AS x, sum(v * k) AS v FROM q, k GROUP BY ALL)""")
    + "SELECT i::BIGINT AS slice, round(sum(abs(v)) * sqrt(pi() / 2) / (6 * (any_value(nx) - 2) * (any_value(ni) - 2)), 4) AS noise FROM o, n GROUP BY i",
)
def _(s, d):
    from ..operators import spectral

    c = a.cube(s, d)
    sl = layouts.to_slices(layouts.to_samples(c).select("il", "xl", "i", "amp"), *a.extent(c))
    return sl.select(F.col("slice").cast("long").alias("slice"), r(spectral.noise_level(F.col("grid"), F.col("n_xl")), 4).alias("noise"))


@query(
    "d13_files_to_merge",
    """WITH f AS (SELECT source, printf('f%06d', doc_id) AS file, n_chars * 1000 < 1000000 AS small FROM documents),
w AS (SELECT *, row_number() OVER o AS n, coalesce(lag(small) OVER o, false) AS before FROM f WINDOW o AS (PARTITION BY source ORDER BY file)),
r AS (SELECT *, sum((small AND NOT before)::INT) OVER (PARTITION BY source ORDER BY file ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM w),
g AS (SELECT source, island, list(file ORDER BY file) AS files, min(n) FILTER (small) AS first, bool_or(NOT small) AS has_next FROM r WHERE small OR before GROUP BY source, island)
SELECT g.source, g.island, CASE WHEN NOT has_next AND w.file IS NOT NULL THEN list_prepend(w.file, files) ELSE files END AS files FROM g LEFT JOIN w ON w.source = g.source AND w.n = g.first - 1""",
)
def _(s, d):
    f = a.table(s, d, "documents").select(F.format_string("f%06d", "doc_id").alias("file"), (F.col("n_chars") * 1000).alias("size"), "source")
    return merging.files_to_merge(f, max_bytes=1_000_000, group="source")


@query("d13_short_file_runs", "WITH d AS (SELECT doc_id, doc_id // 100 AS block, n_chars < 1000 AS small FROM documents), g AS (SELECT *, doc_id - row_number() OVER (PARTITION BY block ORDER BY doc_id) AS k FROM d WHERE small) SELECT block, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY block, k")
def _(s, d):
    f = a.table(s, d, "documents").withColumn("block", F.floor(F.col("doc_id") / 100))
    return windows.islands(f, ["block"], "doc_id", F.col("n_chars") < 1000).select("block", "first", "last", "n")


@query("d14_choose_neighbour", "SELECT doc_id, CASE WHEN doc_id - p < n - doc_id THEN 'previous' ELSE 'next' END AS side FROM (SELECT doc_id, lag(doc_id) OVER w AS p, lead(doc_id) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE p IS NOT NULL AND n IS NOT NULL")
def _(s, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    p = a.table(s, d, "documents").select("doc_id", F.lag("doc_id").over(w).alias("p"), F.lead("doc_id").over(w).alias("n")).where("p is not null and n is not null")
    return p.select("doc_id", merging.choose_neighbour(F.col("doc_id") - F.col("p"), F.col("n") - F.col("doc_id")).alias("side"))


@query(
    "d15_merge_lines",
    """WITH t AS (SELECT l_suppkey AS line, l_linenumber * 2 + l_quantity::INT AS tracl, l_partkey AS tracr, l_quantity::INT AS h FROM lineitem),
u AS (SELECT line, tracl, max(h) AS h FROM t GROUP BY line, tracl),
e AS (SELECT line, unnest(range(lo, hi + 1))::INT AS tracl FROM (SELECT line, min(tracl) AS lo, max(tracl) AS hi FROM u GROUP BY line)),
j AS (SELECT e.line, e.tracl, u.h, CASE WHEN u.h IS NOT NULL THEN e.tracl END AS pos FROM e LEFT JOIN u ON e.line = u.line AND e.tracl = u.tracl),
k AS (SELECT line, tracl, h, last_value(pos IGNORE NULLS) OVER b AS a0, first_value(pos IGNORE NULLS) OVER f AS a1, last_value(h IGNORE NULLS) OVER b AS h0, first_value(h IGNORE NULLS) OVER f AS h1 FROM j
  WINDOW b AS (PARTITION BY line ORDER BY tracl ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY line ORDER BY tracl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT line, tracl, coalesce(h, trunc(h0 + (h1 - h0) * (tracl - a0)::DOUBLE / (a1 - a0)))::INT AS h, row_number() OVER (PARTITION BY line ORDER BY tracl)::INT AS tracr FROM k""",
)
def _(s, d):
    t = a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("line"), (F.col("l_linenumber") * 2 + F.col("l_quantity").cast("int")).alias("tracl"), F.col("l_quantity").cast("int").alias("h"))
    u = t.groupBy("line", "tracl").agg(F.max("h").alias("h"))
    g = windows.gap_fill(u, ["line"], "tracl", ["h"]).select("line", "tracl", "h")
    return merging.renumbered(g, "line", "tracl")


@query("d15_drop_duplicates", "SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber")
def _(s, d):
    t = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return merging.drop_duplicates(t, "l_orderkey", "l_linenumber", "price", ["l_linenumber"])


@query("d16_correlation", a.with_("traces", "samples") + "SELECT a.line, a.tracl, round(corr(a.amp, b.amp), 6) + 0 AS r FROM samples a JOIN samples b ON a.line = b.line AND a.i = b.i AND b.tracl = a.tracl + 1 GROUP BY a.line, a.tracl")
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", "samples")
    b = t.select("line", (F.col("tracl") - 1).alias("tracl"), F.col("samples").alias("b"))
    j = t.join(b, ["line", "tracl"]).select("line", "tracl", F.explode(F.arrays_zip("samples", "b")).alias("z"))
    return j.groupBy("line", "tracl").agg(r(F.corr("z.samples", "z.b")).alias("r"))


def _following(s, d):
    """Two traces that follow each other on different lines stand for a crossing."""
    t = a.traces(s, d)
    p = t.select(F.col("line").alias("line_a"), F.col("samples").alias("samples_a"), F.col("tracl").alias("k"))
    q = t.select(F.col("line").alias("line_b"), F.col("samples").alias("samples_b"), (F.col("tracl") - 1).alias("k"))
    return lines.correlate(p.join(q, "k").where("line_a <> line_b"))


@query("d16_line_shifts")
def _(s, d):
    return lines.line_shifts(_following(s, d), 0.0)


@query("d16_residuals")
def _(s, d):
    """What the shifts leave of every crossing's lag."""
    pairs = _following(s, d).select("line_a", "line_b", "k", "lag", "r")
    return rounded(lines.residuals(pairs, lines.solved_shifts(pairs, 0.0)).select("line_a", "line_b", "k", "lag", "residual"), "residual", digits=5)


# Crossings between customers who order from the same clerk: a network with SQL for its normal equations.
_NET = "net AS (SELECT a.c_nationkey AS line_a, b.c_nationkey AS line_b, (a.c_custkey + b.c_custkey) % 9 - 4 AS lag FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_nationkey <> b.c_nationkey)"


@query(
    "d16_normal_equations",
    f"WITH {_NET}, e AS (SELECT line_a AS line, lag FROM net UNION ALL SELECT line_b, -lag FROM net) SELECT line, 0.0::DOUBLE AS imbalance, count(*) AS n FROM e GROUP BY line",
)
def _(s, d):
    """The solution's check: on every line, what is left of the lags adds up to nothing."""
    c = a.table(s, d, "customer").select("c_custkey", "c_nationkey")
    o = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_nationkey").alias("line_b"))
    pairs = c.join(o, "c_custkey").where(F.col("c_nationkey") != F.col("line_b"))
    pairs = pairs.select(F.col("c_nationkey").alias("line_a"), "line_b", ((2 * F.col("c_custkey") + 1) % 9 - 4).alias("lag"), F.lit(1.0).alias("r"))
    left = lines.residuals(pairs, lines.solved_shifts(pairs, 0.0))
    each = left.select(F.col("line_a").alias("line"), "residual").unionByName(left.select(F.col("line_b").alias("line"), (-F.col("residual")).alias("residual")))
    return each.groupBy("line").agg(r(F.sum("residual"), 5).alias("imbalance"), F.count("*").alias("n"))
