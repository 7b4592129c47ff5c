"""Queries of categories E to M: windows, outliers, amplitudes, spectra, projections, geometry, header texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import layouts
from ..functions import amplitudes, headers, thresholds
from ..kernels import slices as slice_kernels
from ..operators import bands, delays, geometry, lines, outliers, pocs, spectral, windows
from . import adapters as a
from .registry import query, r, rounded

_S = a.with_("series")
_W = "WINDOW w AS (PARTITION BY line ORDER BY k ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"

# --- E: moving windows


@query("e1_moving_window", _S + f"SELECT line, k, list_sum(v) AS total FROM (SELECT line, k, list(round(a, 0)) OVER w AS v FROM series {_W.format(lo=0, hi=4)}) WHERE len(v) = 5 AND (k - 1) % 2 = 0")
def _(s, d):
    m = windows.moving_windows(a.series(s, d).withColumn("a", F.round("a", 0)), ["line"], ["k"], "a", 5, 2)
    return m.select("line", "k", amplitudes.total(F.col("window")).alias("total"))


@query("e2_moving_average", _S + f"SELECT line, k, round(m, 6) + 0 AS mean FROM (SELECT line, k, avg(a) OVER w AS m, count(*) OVER w AS n FROM series {_W.format(lo=0, hi=2)}) WHERE n = 3")
def _(s, d):
    return windows.moving_average(a.series(s, d), ["line"], ["k"], "a", 3).select("line", "k", r("mean").alias("mean"))


@query("e3_moving_average_7", _S + f"SELECT line, k, round(m, 6) + 0 AS mean FROM (SELECT line, k, avg(a) OVER w AS m, count(*) OVER w AS n FROM series {_W.format(lo=0, hi=6)}) WHERE n = 7")
def _(s, d):
    return windows.moving_average(a.series(s, d), ["line"], ["k"], "a", 7).select("line", "k", r("mean").alias("mean"))


@query("e4_moving_median", _S + f"SELECT line, k, round(m, 6) + 0 AS median FROM (SELECT line, k, median(a) OVER w AS m, count(*) OVER w AS n FROM series {_W.format(lo=2, hi=2)}) WHERE n = 5")
def _(s, d):
    return windows.moving_median(a.series(s, d), ["line"], ["k"], "a", 5).select("line", "k", r("median").alias("median"))


_MIRROR = """e AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, first(a) OVER (PARTITION BY line ORDER BY k) AS v0, first(a) OVER (PARTITION BY line ORDER BY k DESC) AS v1 FROM series),
m AS (SELECT line, k, a, true AS own FROM e UNION ALL SELECT line, 2 - k, v0 - abs(a - v0), false FROM e WHERE k BETWEEN 2 AND 3 UNION ALL SELECT line, 2 * n - k, v1 - abs(a - v1), false FROM e WHERE k BETWEEN n - 2 AND n - 1)"""


@query("e4_moving_median_mirrored", a.with_("series", more=_MIRROR) + f"SELECT line, k, round(v, 6) + 0 AS median FROM (SELECT line, k, own, median(a) OVER w AS v FROM m {_W.format(lo=2, hi=2)}) WHERE own")
def _(s, d):
    return windows.moving_median_mirrored(a.series(s, d), ["line"], ["k"], "a", 5).select("line", "k", r("median").alias("median"))


@query("e5_moving_window_2d", a.with_("traces", "samples") + "SELECT a.line, a.tracl, (a.i // 16)::INT AS win, round(avg(abs(b.amp)), 6) AS mean FROM samples a JOIN samples b ON a.line = b.line AND a.i = b.i AND b.tracl BETWEEN a.tracl - 10 AND a.tracl + 10 GROUP BY a.line, a.tracl, a.i // 16")
def _(s, d):
    return rounded(windows.moving_window_2d(layouts.to_samples(a.traces(s, d)), "line", "tracl", "i", "amp", 16, 10), "mean")


#: Hann weights of 11 samples over traces that go on along the lines through their first and last five samples.
_HANN = """f AS (SELECT line, tracl, regr_slope(amp, i) FILTER (i < 5) AS s0, regr_intercept(amp, i) FILTER (i < 5) AS c0, regr_slope(amp, i) FILTER (i >= 59) AS s1, regr_intercept(amp, i) FILTER (i >= 59) AS c1 FROM samples GROUP BY line, tracl),
x AS (SELECT line, tracl, i, amp FROM samples UNION ALL SELECT line, tracl, j::INT, c0 + s0 * j FROM f, range(-5, 0) r(j) UNION ALL SELECT line, tracl, j::INT, c1 + s1 * j FROM f, range(64, 69) r(j)),
sm AS (SELECT a.line, a.tracl, a.i, any_value(a.amp) AS amp, sum(b.amp * (0.5 - 0.5 * cos(2 * pi() * (b.i - a.i + 5) / 10))) / 5 AS m FROM samples a JOIN x b ON a.line = b.line AND a.tracl = b.tracl AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY a.line, a.tracl, a.i)"""


@query("e6_smooth", a.with_("traces", "samples", more=_HANN) + "SELECT line, tracl, i, round(m, 6) + 0 AS amp FROM sm")
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.smooth(F.col("samples"), 11)).alias("i", "amp"))
    return rounded(t, "amp")


#: Orthogonal polynomials on 64 equidistant points, of degree 0 to 3.
_GRAM = ("1", "t", "(t * t - 4095 / 12.0::DOUBLE)", "(t * t * t - t * (3 * 4096 - 7) / 20.0::DOUBLE)")


@query(
    "e7_polynomial_filter",
    a.with_("traces", "samples", more="g AS (SELECT *, i - 31.5::DOUBLE AS t FROM samples), c AS (SELECT line, tracl, " + ", ".join(f"sum(amp * {p}) / sum({p} * {p}) AS c{k}" for k, p in enumerate(_GRAM)) + " FROM g GROUP BY line, tracl)")
    + "SELECT line, tracl, i, round(amp - (" + " + ".join(f"c{k} * {p}" for k, p in enumerate(_GRAM)) + "), 5) + 0 AS amp FROM g JOIN c USING (line, tracl)",
)
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.polynomial(F.col("samples"), 3)).alias("i", "amp"))
    return rounded(t, "amp", digits=5)


@query("e7_linear_trend", a.with_("traces", "samples") + "SELECT line, tracl, round(regr_slope(amp, i), 8) + 0 AS slope, round(regr_intercept(amp, i), 6) + 0 AS icpt FROM samples GROUP BY line, tracl")
def _(s, d):
    t = layouts.to_samples(a.traces(s, d))
    return t.groupBy("line", "tracl").agg(r(F.regr_slope("amp", "i"), 8).alias("slope"), r(F.regr_intercept("amp", "i")).alias("icpt"))


@query("e8_sta_lta", _S + "SELECT line, k, round(CASE WHEN k < 20 OR l = 0 THEN 0 ELSE sa / 5 / (l / 20) END, 6) + 0 AS ratio FROM (SELECT line, k, sum(a * a) OVER (PARTITION BY line ORDER BY k ROWS 4 PRECEDING) AS sa, sum(a * a) OVER (PARTITION BY line ORDER BY k ROWS 19 PRECEDING) AS l FROM series)")
def _(s, d):
    return windows.sta_lta(a.series(s, d), ["line"], ["k"], "a", 5, 20).select("line", "k", r("ratio").alias("ratio"))


_TW = "WINDOW w AS (PARTITION BY line, tracl ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


def _agc_sql(g: str, y: str = "amp / g") -> str:
    return a.with_("traces", "samples", more=f"g AS (SELECT line, tracl, i, amp, {g} AS g FROM samples {_TW})") + f"SELECT line, tracl, i, round({y}, 6) + 0 AS amp FROM g"


def _agc(s, d, **options):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.agc(F.col("samples"), 11, **options)).alias("i", "amp"))
    return rounded(t, "amp")


@query("e9_agc_rms", _agc_sql("sqrt(sum(amp * amp) OVER w / 11)"))
def _(s, d):
    return _agc(s, d)


@query("e9_agc_mean_long", _agc_sql("sum(abs(amp) + 0.1::DOUBLE) OVER w / 11"))
def _(s, d):
    t = layouts.to_samples(a.traces(s, d)).withColumn("m", F.abs("amp") + F.lit(0.1))
    g = windows.agc_long(t, ["line", "tracl"], ["i"], "m", 11, "mean")
    return g.select("line", "tracl", "i", r(F.col("amp") / F.col("gain")).alias("amp"))


@query("e9_agc_squared", _agc_sql("sqrt(sum(amp * amp) OVER w / 11)", "sign(amp) * (amp / g) * (amp / g)"))
def _(s, d):
    return _agc(s, d, squared=True)


@query("e9_agc_median", _agc_sql("list_median(list_concat(list(abs(amp)) OVER w, list_transform(range(11 - count(*) OVER w), lambda x: 0.0::DOUBLE)))", "CASE WHEN g = 0 THEN abs(amp) ELSE abs(amp) / g END"))
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.agc(F.transform("samples", F.abs), 11, "median")).alias("i", "amp"))
    return rounded(t, "amp")


# --- F: outliers


@query("f1_zscore", _S + "SELECT line, k, abs(a - avg(a) OVER w) / stddev_pop(a) OVER w > 1 AS outlier FROM series WINDOW w AS (PARTITION BY line)")
def _(s, d):
    return outliers.zscore(a.series(s, d), ["line"], "a").select("line", "k", "outlier")


@query("f3_iqr", _S + "SELECT line, k, a < q1 - 1.5 * (q3 - q1) OR a > q3 + 1.5 * (q3 - q1) AS outlier FROM series JOIN (SELECT line, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM series GROUP BY line) USING (line)")
def _(s, d):
    return outliers.iqr(a.series(s, d), ["line"], "a").select("line", "k", "outlier")


_MED = "md AS (SELECT line, median(a) AS m FROM series GROUP BY line)"


@query("f4_mad", a.with_("series", more=f"{_MED}, mm AS (SELECT line, m, median(abs(a - m)) AS mad FROM series JOIN md USING (line) GROUP BY line, m)") + "SELECT line, k, abs(a - m) / CASE WHEN mad = 0 THEN 1 ELSE mad END > 3 AS outlier FROM series JOIN mm USING (line)")
def _(s, d):
    return outliers.mad(a.series(s, d), ["line"], "a").select("line", "k", "outlier")


_DOUBLE = f"{_MED}, mm AS (SELECT line, m, median(abs(a - m)) FILTER (a <= m) AS l, median(abs(a - m)) FILTER (a >= m) AS r FROM series JOIN md USING (line) GROUP BY line, m)"


@query("d11_mad", a.with_("series", more=_MED) + "SELECT line, round(m, 6) AS median, round(median(abs(a - m)), 6) AS mad FROM series JOIN md USING (line) GROUP BY line, m")
def _(s, d):
    return rounded(outliers.mad_of(a.series(s, d), ["line"], "a"), "median", "mad")


@query("d12_double_mad", a.with_("series", more=_DOUBLE) + 'SELECT line, round(m, 6) AS median, round(l, 6) AS "left", round(r, 6) AS "right" FROM mm')
def _(s, d):
    return rounded(outliers.double_mad_of(a.series(s, d), ["line"], "a"), "median", "left", "right")


@query("f4_double_mad", a.with_("series", more=_DOUBLE) + "SELECT line, k, abs(a - m) / CASE WHEN CASE WHEN a >= m THEN r ELSE l END = 0 THEN 1 ELSE CASE WHEN a >= m THEN r ELSE l END END > 3 AS outlier FROM series JOIN mm USING (line)")
def _(s, d):
    return outliers.mad(a.series(s, d), ["line"], "a", mode="double").select("line", "k", "outlier")


_RMAD = a.with_("series", more=_MIRROR + f", x AS (SELECT line, k, a, own, list(a) OVER w AS v FROM m {_W.format(lo=2, hi=2)}), y AS (SELECT *, list_median(v) AS md FROM x WHERE own), z AS (SELECT *, list_median(list_transform(v, lambda t: abs(t - md))) AS mad FROM y)")


@query("f5_moving_mad", _RMAD + "SELECT line, k, abs(a - md) / CASE WHEN mad = 0 THEN 1 ELSE mad END > 3 AS outlier FROM z")
def _(s, d):
    return outliers.moving_mad(a.series(s, d), ["line"], ["k"], "a", 5).select("line", "k", "outlier")


def _interp_sql(new: str) -> str:
    return a.with_(
        "series",
        more="""q AS (SELECT line, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM series GROUP BY line), o AS (SELECT line, k, a, a < q1 - 1.5 * (q3 - q1) OR a > q3 + 1.5 * (q3 - q1) AS bad FROM series JOIN q USING (line)),
g AS (SELECT *, last_value(CASE WHEN NOT bad THEN k END IGNORE NULLS) OVER b AS k0, first_value(CASE WHEN NOT bad THEN k END IGNORE NULLS) OVER f AS k1, last_value(CASE WHEN NOT bad THEN a END IGNORE NULLS) OVER b AS a0, first_value(CASE WHEN NOT bad THEN a END IGNORE NULLS) OVER f AS a1 FROM o
WINDOW b AS (PARTITION BY line ORDER BY k ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY line ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    ) + f"SELECT line, k, round(CASE WHEN bad AND k0 IS NOT NULL AND k1 IS NOT NULL THEN {new} ELSE a END, 6) + 0 AS a FROM g"


for _kind, _new in (("linear", "a0 + (a1 - a0) * (k - k0)::DOUBLE / (k1 - k0)"), ("previous", "a0"), ("next", "a1"), ("nearest", "CASE WHEN k - k0 <= k1 - k THEN a0 ELSE a1 END")):

    def _f6(s, d, kind=_kind):
        return rounded(outliers.replaced(a.series(s, d), ["line"], ["k"], "a", "IQR", kind).select("line", "k", "a"), "a")

    query(f"f6_interpolate_{_kind}", _interp_sql(_new))(_f6)


@query("f2_moving_zscore", a.with_("traces", "samples", more=_HANN) + "SELECT line, tracl, i, abs(amp - m) / stddev_pop(amp) OVER (PARTITION BY line, tracl) > 1 AS outlier FROM sm")
def _(s, d):
    t = layouts.to_samples(a.traces(s, d)).select("line", "tracl", "i", "amp")
    return outliers.moving_zscore(t, ["line", "tracl"], ["i"], "amp", 11).select("line", "tracl", "i", "outlier")


@query("f6_interpolate_cubic")
def _(s, d):
    t = a.traces(s, d)
    med = amplitudes.median_of(F.transform("samples", F.abs))
    t = t.withColumn("bad", F.transform("samples", lambda x, i: (F.abs(x) > 3 * med) & (i > 0) & (i < 63)))
    return rounded(t.select("line", "tracl", F.posexplode(spectral.cubic_fill(F.col("samples"), F.col("bad"))).alias("i", "amp")), "amp")


@query("f7_missing_values", "SELECT event_id, value < 10 AS missing FROM events")
def _(s, d):
    v = F.when(F.col("value") < 10, float("nan")).otherwise(F.col("value"))
    return a.table(s, d, "events").select("event_id", outliers.missing(v).alias("missing"))


@query("f8_programmed_gain", "SELECT p_partkey, round(CASE WHEN t <= 0.5 THEN 1 WHEN t <= 2 THEN 1 + (t - 0.5) * 2 / 1.5 WHEN t <= 3 THEN 3 - (t - 2) * 2.5 ELSE 0.5 END, 6) AS gain FROM (SELECT p_partkey, p_size * 0.08 AS t FROM part)".replace("0.5", "0.5::DOUBLE").replace("/ 1.5", "/ 1.5::DOUBLE").replace("0.08", "0.08::DOUBLE"))
def _(s, d):
    g = amplitudes.knots(F.array(F.col("p_size") * F.lit(0.08)), [(0.5, 1), (2, 3), (3, 0.5)])
    return a.table(s, d, "part").select("p_partkey", r(g[0]).alias("gain"))


# --- G: per-trace amplitude and time shift

_T = "i * 0.05::DOUBLE"


def _gain_sql(amp: str, more: str = "") -> str:
    return a.with_("traces", "samples", *(), more=more) + f"SELECT line, tracl, i, round({amp}, 6) + 0 AS amp FROM samples"


def _gained(s, d, **options):
    t = F.transform("samples", lambda x, i: i * F.lit(0.05))
    g = a.traces(s, d).select("line", "tracl", F.posexplode(amplitudes.gain(F.col("samples"), t, **options)).alias("i", "amp"))
    return rounded(g, "amp")


_Q = "(SELECT line, tracl, quantile_cont(abs(amp), 0.9) AS q FROM samples GROUP BY line, tracl)"
for _name, _sql, _options in (
    ("bias", "amp + 0.25::DOUBLE", {"bias_value": 0.25}),
    ("tpow", f"amp * pow({_T}, 2)", {"tpow_value": 2}),
    ("epow", f"amp * exp(0.3::DOUBLE * {_T})", {"epow_value": 0.3}),
    ("ebase", f"amp * pow(2, 0.3::DOUBLE * {_T})", {"epow_value": 0.3, "ebase": 2}),
    ("gpow", "sign(amp) * pow(abs(amp), 0.5)", {"gpow_value": 0.5}),
    ("clip", "greatest(-0.1::DOUBLE, least(0.1::DOUBLE, amp))", {"clip_value": 0.1}),
    ("pclip", "least(0.05::DOUBLE, amp)", {"pclip": 0.05}),
    ("nclip", "greatest(-0.05::DOUBLE, amp)", {"nclip": -0.05}),
    ("linear", "amp * (1 + 2 * i / 63::DOUBLE)", {"linear": (1, 3)}),
    ("pgc", f"amp * CASE WHEN {_T} <= 1 THEN 1 WHEN {_T} <= 2 THEN 1 + ({_T} - 1) * 3 ELSE 4 END", {"pgc": [(1, 1), (2, 4)]}),
    ("scale", "amp * 2.5::DOUBLE", {"scale": 2.5}),
    ("chain", f"greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (amp + 0.1::DOUBLE) * pow({_T}, 1) * exp(0.2::DOUBLE * {_T}))) / 2", {"bias_value": 0.1, "tpow_value": 1, "epow_value": 0.2, "clip_value": 0.5, "scale": 2.0, "norm": True}),
):
    query(f"g1_gain_{_name}", _gain_sql(_sql))(lambda s, d, o=_options: _gained(s, d, **o))


@query("g1_gain_qclip", a.with_("traces", "samples") + f"SELECT line, tracl, i, round(greatest(-q, least(q, amp)), 6) + 0 AS amp FROM samples JOIN {_Q} USING (line, tracl)")
def _(s, d):
    return _gained(s, d, qclip_value=0.9)


def _shift_sql(n: str) -> str:
    """Samples moved down by n (up for negative n)."""
    return a.with_("traces", "samples", more=f"sh AS (SELECT line, tracl, {n} AS n FROM traces), z AS (SELECT line, tracl, n, unnest(range(64))::INT AS i FROM sh)") + "SELECT z.line, z.tracl, z.i, coalesce(amp, 0) AS amp FROM z LEFT JOIN samples s ON s.line = z.line AND s.tracl = z.tracl AND s.i = z.i - z.n"


def _shifted(s, d, f):
    return a.traces(s, d).select("line", "tracl", F.posexplode(f(F.col("samples"))).alias("i", "amp"))


def _k_shift():
    return F.col("tracl") % 21 - 10


@query("g5_static", _shift_sql("(tracl % 21 - 10)::INT"))
def _(s, d):
    return _shifted(s, d, lambda x: amplitudes.compensate_static(x, _k_shift() * F.lit(0.05), F.lit(0.05)))


@query("g6_tide", _shift_sql("(-round_even((tracl % 21 - 10) * 0.3::DOUBLE / 750 / (0.05::DOUBLE * 0.001::DOUBLE), 0))::INT"))
def _(s, d):
    n = amplitudes.tide_samples(_k_shift() * F.lit(0.3), F.lit(0.05))
    return _shifted(s, d, lambda x: amplitudes.compensate_tide(x, n))


@query("g7_mistie", _shift_sql("(line - 5)::INT"))
def _(s, d):
    return _shifted(s, d, lambda x: amplitudes.compensate_mistie(x, F.col("line") - 5))


@query("g2_pad_trace", a.with_("traces", "samples", more="z AS (SELECT line, tracl, round_even((delrt - 0.2::DOUBLE) / 0.05::DOUBLE, 0)::INT AS n, unnest(range(66))::INT AS i FROM traces)") + "SELECT z.line, z.tracl, z.i, coalesce(amp, 0) AS amp FROM z LEFT JOIN samples s ON s.line = z.line AND s.tracl = z.tracl AND s.i = z.i - z.n")
def _(s, d):
    return _shifted(s, d, lambda x: amplitudes.fit_axis(x, F.col("delrt"), F.col("dt"), F.lit(0.2), 66))


@query("g3_pad_delays", a.with_("traces", "samples", more="z AS (SELECT line, tracl, round_even((delrt - min(delrt) OVER w) / 0.05::DOUBLE, 0)::INT AS n, 64 + round_even((max(delrt) OVER w - min(delrt) OVER w) / 0.05::DOUBLE, 0)::INT AS size FROM traces WINDOW w AS (PARTITION BY line)), y AS (SELECT *, unnest(range(size))::INT AS i FROM z)") + "SELECT y.line, y.tracl, y.i, coalesce(amp, 0) AS amp FROM y LEFT JOIN samples s ON s.line = y.line AND s.tracl = y.tracl AND s.i = y.i - y.n")
def _(s, d):
    return delays.pad_delays(a.traces(s, d)).select("line", "tracl", F.posexplode("samples").alias("i", "amp"))


@query(
    "g4_static_lowpass",
    a.with_("series", more="m AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, avg(a) OVER (PARTITION BY line ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mid FROM series), f AS (SELECT line, regr_slope(a, k) FILTER (k <= 7) AS s0, regr_intercept(a, k) FILTER (k <= 7) AS i0, regr_slope(a, k) FILTER (k > n - 7) AS s1, regr_intercept(a, k) FILTER (k > n - 7) AS i1 FROM m GROUP BY line)")
    + "SELECT line, k, round(CASE WHEN n < 7 THEN a WHEN k <= 3 THEN s0 * k + i0 WHEN k > n - 3 THEN s1 * k + i1 ELSE mid END - a, 6) + 0 AS static FROM m JOIN f USING (line)",
)
def _(s, d):
    return delays.lowpass_static(a.series(s, d), "line", "k", "a", 7).select("line", "k", r("static").alias("static"))


@query("g4_static")
def _(s, d):
    p = a.series(s, d).select("line", F.col("k").alias("tracl"), F.rint("a").cast("long").alias("pick"))
    return rounded(lines.statics(p, depressions=(10, 10, 5)), "static", digits=4)


@query("g4_limited", _S + "SELECT line, k, greatest(-12, least(12, round(a, 3) - 50)) AS static FROM series")
def _(s, d):
    return a.series(s, d).select("line", "k", delays.limited(F.round("a", 3) - 50, 12).alias("static"))


@query("g8_varying_delays", "SELECT user_id AS line, count(DISTINCT event_type) AS n_delays, count(DISTINCT event_type) > 1 AS varies FROM events GROUP BY user_id")
def _(s, d):
    return delays.varying_delays(a.table(s, d, "events"), "user_id", "event_type").withColumnRenamed("user_id", "line")


@query("g9_correct_delays")
def _(s, d):
    t = a.traces(s, d).withColumn("samples", F.when(F.col("tracl") % 100 < 50, F.col("samples")).otherwise(F.transform("samples", lambda x: x * 0.01)))
    t = t.withColumn("delrt", F.when(F.col("tracl") % 100 < 45, 10.0).otherwise(20.0))
    return delays.correct_delays(t, n_samples=16).select("line", "tracl", "delrt_new")


_EV = "e AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS k, event_type AS v FROM events)"


@query("g10_change_points", f"WITH {_EV} SELECT line, k, k > 1 AND v <> lag(v) OVER (PARTITION BY line ORDER BY k) AS changed FROM e".replace("k > 1 AND v <> lag(v) OVER (PARTITION BY line ORDER BY k)", "coalesce(v <> lag(v) OVER (PARTITION BY line ORDER BY k), false)"))
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = a.table(s, d, "events").select(F.col("user_id").alias("line"), F.row_number().over(w).alias("k"), F.col("event_type").alias("v"))
    return windows.change_points(e, ["line"], ["k"], "v").select("line", "k", "changed")


@query("y_segments", f"WITH {_EV}, c AS (SELECT line, k, CASE WHEN coalesce(v <> lag(v) OVER (PARTITION BY line ORDER BY k), false) THEN 1 ELSE 0 END AS c FROM e) SELECT line, k, (sum(c) OVER (PARTITION BY line ORDER BY k))::BIGINT AS segment FROM c")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = a.table(s, d, "events").select(F.col("user_id").alias("line"), F.row_number().over(w).alias("k"), F.col("event_type").alias("v"))
    return windows.segments(e, ["line"], ["k"], "v").select("line", "k", "segment")


@query("g11_spike_flags", a.with_("traces", "samples") + "SELECT line, tracl, i, abs(amp) > 2 * m AS spike FROM (SELECT line, tracl, i, amp, round(avg(abs(amp)) OVER (PARTITION BY line, i ORDER BY tracl ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS m FROM samples)")
def _(s, d):
    w = windows.over(["line", "i"], ["tracl"], -2, 2)
    t = layouts.to_samples(a.traces(s, d))
    return t.select("line", "tracl", "i", (F.abs("amp") > 2 * F.round(F.avg(F.abs("amp")).over(w), 9)).alias("spike"))


@query("g11_despike")
def _(s, d):
    t = lines.despike(a.traces(s, d), window=0.8, dt=0.05, threshold=2.0)
    return t.select("line", "tracl", "n_replaced", r(amplitudes.total(F.col("samples"))).alias("total"))


# --- H: detection


@query("h1_seafloor")
def _(s, d):
    return lines.pick_seafloor(a.traces(s, d), win=8)


@query("h1_top_amplitudes", a.with_("traces", "samples") + "SELECT line, tracl, i, amp FROM (SELECT *, row_number() OVER (PARTITION BY line, tracl ORDER BY amp DESC, i) AS r FROM samples) WHERE r <= 5")
def _(s, d):
    w = Window.partitionBy("line", "tracl").orderBy(F.col("amp").desc(), "i")
    return layouts.to_samples(a.traces(s, d)).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("line", "tracl", "i", "amp")


@query("h2_correlation_lag", a.with_("traces") + "SELECT line, tracl, (32 - (CASE WHEN abs(list_min(s)) > abs(list_max(s)) THEN list_position(s, list_min(s)) ELSE list_position(s, list_max(s)) END - 1))::INT AS lag FROM traces")
def _(s, d):
    return a.traces(s, d).select("line", "tracl", amplitudes.cross_correlation_lag(F.col("samples")).alias("lag"))


# --- I: spectra

_DFT = "dft AS (SELECT line, tracl, k.k::INT AS k, sum(amp * cos(2 * pi() * k.k * i / 64)) AS re, -sum(amp * sin(2 * pi() * k.k * i / 64)) AS im FROM samples, range(33) k(k) GROUP BY line, tracl, k.k)"


@query("i10_fft", a.with_("traces", "samples", more=_DFT) + "SELECT line, tracl, k, round(re * 0.05, 6) + 0 AS re, round(im * 0.05, 6) + 0 AS im FROM dft")
def _(s, d):
    t = a.traces(s, d).withColumn("z", spectral.fft(layouts.even("samples"), 0.05, real=True))
    e = t.select("line", "tracl", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("k", "v")).select("line", "tracl", "k", F.col("v.re").alias("re"), F.col("v.im").alias("im"))
    return rounded(e, "re", "im")


@query("i11_inverse_fft", a.with_("traces", "samples") + "SELECT line, tracl, i, round(amp, 6) + 0 AS amp FROM samples")
def _(s, d):
    t = a.traces(s, d).withColumn("z", spectral.fft(F.col("samples"), 0.05, 1.5, real=True))
    return rounded(t.select("line", "tracl", F.posexplode(spectral.ifft(F.col("z"), 0.05, 1.5, real=True)).alias("i", "amp")), "amp")


@query(
    "i1_envelope",
    a.with_("traces", "samples", more=_DFT + ", h AS (SELECT d.line, d.tracl, i.i::INT AS i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * i.i / 64) - im * sin(2 * pi() * k * i.i / 64))) / 64 AS a, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * sin(2 * pi() * k * i.i / 64) + im * cos(2 * pi() * k * i.i / 64))) / 64 AS b FROM dft d, range(64) i(i) GROUP BY d.line, d.tracl, i.i)")
    + "SELECT line, tracl, i, round(sqrt(a * a + b * b), 6) + 0 AS amp FROM h",
)
def _(s, d):
    t = a.traces(s, d)
    return rounded(t.select("line", "tracl", F.posexplode(spectral.envelope(F.col("samples"))).alias("i", "amp")), "amp")


_TAPER = "(0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63) + 0.08::DOUBLE * cos(4 * pi() * i / 63))"


@query(
    "i2_spectrum",
    a.with_("traces", "samples") + f"SELECT line, tracl, k.k::INT AS k, round(2 * sqrt(pow(sum(amp * {_TAPER} * cos(2 * pi() * k.k * i / 64)), 2) + pow(sum(amp * {_TAPER} * sin(2 * pi() * k.k * i / 64)), 2)) / sum({_TAPER}), 6) + 0 AS a FROM samples, range(33) k(k) GROUP BY line, tracl, k.k",
)
def _(s, d):
    t = a.traces(s, d)
    return rounded(t.select("line", "tracl", F.posexplode(spectral.frequency_spectrum(F.col("samples"), 20.0)).alias("k", "a")), "a")


@query("n8_average_spectrum", a.with_("traces", "samples", more=_DFT) + "SELECT k, round(avg(2 * sqrt(re * re + im * im) / 64), 6) + 0 AS amplitude FROM dft GROUP BY k")
def _(s, d):
    return rounded(spectral.average_spectrum(a.traces(s, d), 20.0, taper=False), "amplitude")


for _kind, _freqs in (("lowpass", 4.0), ("highpass", 2.0), ("bandpass", (2.0, 6.0))):

    def _i4(s, d, kind=_kind, freqs=_freqs):
        t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.butterworth(F.col("samples"), kind, freqs, 20.0, 4)).alias("i", "amp"))
        return rounded(t, "amp")

    query(f"i4_butterworth_{_kind}")(_i4)


@query("i5_filter_frequency")
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.filter_frequency(F.col("samples"), (3.0, 5.0), 20.0, "lowpass")).alias("i", "amp"))
    return rounded(t, "amp")


@query("i6_stopband", a.with_("traces", "samples") + "SELECT line, tracl, i, round(amp * (0.5 - 0.5 * cos(pi() * (i + 1) / 12)), 9) + 0 AS high, round(amp * (0.5 - 0.5 * cos(pi() * (13 + i) / 12)), 9) + 0 AS low FROM samples WHERE i < 12")
def _(s, d):
    """The ramps over the first samples of every trace."""
    z = F.arrays_zip(F.slice("samples", 1, 12).alias("s"), spectral.stopband(12, "highpass").alias("h"), spectral.stopband(12, "lowpass").alias("l"))
    t = a.traces(s, d).select("line", "tracl", F.posexplode(z).alias("i", "v"))
    return t.select("line", "tracl", "i", r(F.col("v.s") * F.col("v.h"), 9).alias("high"), r(F.col("v.s") * F.col("v.l"), 9).alias("low"))


@query("i7_outside_values", "SELECT p_partkey, kind, CASE WHEN p_size < 10 THEN low ELSE high END AS value FROM part, (VALUES ('highpass', 0, 1), ('lowpass', 1, 0), ('bandpass', 0, 0)) t(kind, low, high) WHERE p_size < 10 OR p_size > 40")
def _(s, d):
    """Parts' sizes as frequencies outside of a taper from 10 to 40."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for k, (lo, hi) in spectral.OUTSIDE.items()])).alias("o")
    p = a.table(s, d, "part").where("p_size < 10 OR p_size > 40").select("p_partkey", "p_size", sides)
    return p.select("p_partkey", "o.kind", F.when(F.col("p_size") < 10, F.col("o.low")).otherwise(F.col("o.high")).alias("value"))


_UP = "CASE WHEN f <= {0} THEN 0 WHEN f >= {1} THEN 1 ELSE 0.5 - 0.5 * cos(pi() * (f - {0}) / ({1} - {0})) END"


@query("i8_taper", f"SELECT i, round(1 - {_UP.format(3, 6)}, 9) + 0 AS lowpass, round({_UP.format(3, 6)}, 9) + 0 AS highpass, round({_UP.format(1, 2)} * (1 - {_UP.format(5, 8)}), 9) + 0 AS bandpass FROM (SELECT p_partkey AS i, p_size * 0.25::DOUBLE AS f FROM part)")
def _(s, d):
    f = F.col("p_size") * F.lit(0.25)
    t = lambda q, k: r(spectral.taper(f, q, k), 9).alias(k)
    return a.table(s, d, "part").select(F.col("p_partkey").alias("i"), t((3, 6), "lowpass"), t((3, 6), "highpass"), t((1, 2, 5, 8), "bandpass"))


@query("i9_frequency_mask", "SELECT p_partkey AS i, p_size * 0.25 <= 6 AS low, p_size * 0.25 >= 3 AS high, p_size * 0.25 BETWEEN 1 AND 8 AS band FROM part")
def _(s, d):
    f = F.col("p_size") * F.lit(0.25)
    return a.table(s, d, "part").select(F.col("p_partkey").alias("i"), spectral.keeps(f, (3, 6)).alias("low"), spectral.keeps(f, (3, 6), "highpass").alias("high"), spectral.keeps(f, (1, 2, 5, 8), "bandpass").alias("band"))


@query("i11_rescale_envelope", a.with_("traces", "samples", more="e AS (SELECT line, tracl, i, greatest(0, amp) AS v FROM samples)") + "SELECT line, tracl, i, round((v - lo) / (hi - lo), 6) + 0 AS amp FROM e, (SELECT min(v) AS lo, max(v) AS hi FROM e)")
def _(s, d):
    t = layouts.to_samples(a.traces(s, d)).select("line", "tracl", "i", "amp")
    return rounded(spectral.rescale_envelope(t), "amp")


@query("i12_gaussian_kernel", "SELECT p_partkey, round(exp(-((p_size % 17 - 8) ** 2) / 8.0::DOUBLE) * exp(-((p_partkey % 17 - 8) ** 2) / 8.0::DOUBLE) / (2 * pi() * 4), 9) AS k FROM part")
def _(s, d):
    """The kernel's weight at a place that each part has by its size and number."""
    k = F.array(*[F.lit(float(v)) for v in slice_kernels.gaussian_kernel(2).ravel()])
    return a.table(s, d, "part").select("p_partkey", r(F.get(k, (F.col("p_size") % 17 * 17 + F.col("p_partkey") % 17).cast("int")), 9).alias("k"))


def _cube_slices(s, d):
    c = a.cube(s, d)
    n_il, n_xl = a.extent(c)
    return layouts.to_slices(layouts.to_samples(c).select("il", "xl", "i", "amp"), n_il, n_xl), n_il, n_xl


def _smoothed(s, d, name):
    c = a.cube(s, d)
    return rounded(spectral.smooth_cube(c, *a.extent(c), name), "amp")


def _cells(sl):
    return rounded(layouts.from_slices(sl).select(F.col("slice").cast("long").alias("slice"), "il", "xl", "amp"), "amp")


@query(
    "i13_smooth_median",
    a.with_("cube", "grid", more="o AS (SELECT a.i, a.il, a.xl, b.amp FROM grid a, n, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx), grid b WHERE b.i = a.i AND b.il = greatest(1, least(ni, a.il + dy)) AND b.xl = greatest(1, least(nx, a.xl + dx)))")
    + "SELECT i::BIGINT AS slice, il, xl, round(median(amp), 6) + 0 AS amp FROM o GROUP BY i, il, xl",
)
def _(s, d):
    return _smoothed(s, d, "median")


def _gauss(axis: str, n: str, of: str, other: str) -> str:
    """One pass of a Gaussian of sigma 1, cut at 4 and reflected at the borders, along an axis of the grid."""
    at = f"CASE WHEN {axis} + d < 1 THEN 1 - ({axis} + d) WHEN {axis} + d > {n} THEN 2 * {n} + 1 - ({axis} + d) ELSE {axis} + d END"
    return f"(SELECT a.i, a.il, a.xl, sum(b.amp * w) AS amp FROM (SELECT i, il, xl, w, {at} AS at FROM {of}, n, gw) a JOIN {of} b ON b.i = a.i AND b.{axis} = a.at AND b.{other} = a.{other} GROUP BY a.i, a.il, a.xl)"


@query(
    "i13_smooth_gaussian",
    a.with_("cube", "grid", more=f"gw AS (SELECT d, exp(-d * d / 2.0::DOUBLE) / sum(exp(-d * d / 2.0::DOUBLE)) OVER () AS w FROM range(-4, 5) r(d)), p1 AS {_gauss('il', 'ni', 'grid', 'xl')}, p2 AS {_gauss('xl', 'nx', 'p1', 'il')}") + "SELECT i::BIGINT AS slice, il, xl, round(amp, 6) + 0 AS amp FROM p2",
)
def _(s, d):
    return _smoothed(s, d, "gaussian")


@query("i14_remove_footprint")
def _(s, d):
    return _cells(spectral.remove_footprint(*_cube_slices(s, d), sigma=2))


@query("i15_antialias")
def _(s, d):
    return _cells(spectral.antialias(*_cube_slices(s, d), (1, 2), sigma=2))


_UPS = a.with_("cube", more="""h AS (SELECT il, xl, s[1] AS amp FROM cube WHERE xl % 3 = 1), e AS (SELECT il, unnest(range(lo, hi + 1))::INT AS xl FROM (SELECT il, min(xl) AS lo, max(xl) AS hi FROM h GROUP BY il)), j AS (SELECT e.il, e.xl, amp, CASE WHEN amp IS NOT NULL THEN e.xl END AS pos FROM e LEFT JOIN h ON h.il = e.il AND h.xl = e.xl),
g AS (SELECT *, last_value(pos IGNORE NULLS) OVER b AS p0, first_value(pos IGNORE NULLS) OVER f AS p1, last_value(amp IGNORE NULLS) OVER b AS a0, first_value(amp IGNORE NULLS) OVER f AS a1 FROM j WINDOW b AS (PARTITION BY il ORDER BY xl ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY il ORDER BY xl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")  # fmt: skip
for _kind, _new in (("linear", "a0 + (a1 - a0) * (xl - p0)::DOUBLE / (p1 - p0)"), ("nearest", "CASE WHEN xl - p0 <= p1 - xl THEN a0 ELSE a1 END")):

    def _i16(s, d, kind=_kind):
        h = a.cube(s, d).where("xl % 3 = 1").select("il", "xl", F.get("samples", F.lit(0)).alias("amp"))
        return rounded(spectral.upsample(h, "xl", ["il"], method=kind), "amp")

    query(f"i16_upsample_{_kind}", _UPS + f"SELECT il, xl, round(CASE WHEN amp IS NOT NULL THEN amp ELSE {_new} END, 6) + 0 AS amp FROM g")(_i16)


@query(
    "y_resample",
    a.with_("traces", "samples", more=_DFT) + "SELECT line, tracl, j::INT AS i, round(sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * j / 128) - CASE WHEN k = 32 THEN 0 ELSE im * sin(2 * pi() * k * j / 128) END)) / 64, 6) + 0 AS amp FROM dft, range(128) r(j) GROUP BY line, tracl, j",
)
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.resample(F.col("samples"), 0.5)).alias("i", "amp"))
    return rounded(t, "amp")


@query(
    "y_resample_poly",
    a.with_("traces", "samples", more="h AS (SELECT t, w / sum(w) OVER () AS w FROM (SELECT t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 2) / (pi() * t / 2) END * (0.5 + 0.5 * cos(pi() * t / 20)) AS w FROM range(-20, 21) r(t)))")
    + "SELECT line, tracl, j::INT AS i, round(sum(amp * w), 6) + 0 AS amp FROM samples JOIN (SELECT j, 2 * j - t AS i, w FROM h, range(32) r(j)) USING (i) GROUP BY line, tracl, j",
)
def _(s, d):
    t = a.traces(s, d).select("line", "tracl", F.posexplode(spectral.resample_poly(F.col("samples"), 2)).alias("i", "amp"))
    return rounded(t, "amp")


@query("y_even_length", a.with_("traces") + "SELECT line, tracl, (len(s) - 2)::INT AS n FROM traces")
def _(s, d):
    t = a.traces(s, d).withColumn("samples", F.slice("samples", F.lit(1), F.size("samples") - 1))
    return t.select("line", "tracl", F.size(layouts.even("samples")).alias("n"))


@query("y_swdep_scaling", "SELECT o_orderkey, (CASE WHEN min(k) OVER w > 0 THEN o_totalprice * k WHEN max(k) OVER w < 0 THEN o_totalprice / abs(k) ELSE o_totalprice END)::DOUBLE AS swdep FROM (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN -100 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE -10 END END AS k FROM orders) WINDOW w AS (PARTITION BY o_custkey)")
def _(s, d):
    c = F.col("o_custkey") % 3
    k = F.when(c == 0, 10).when(c == 1, -100).otherwise(F.when(F.col("o_orderkey") % 2 == 0, 10).otherwise(-10))
    o = a.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("line"), F.col("o_totalprice").alias("swdep"), k.alias("scalel"))
    return delays.swdep_scaled(o).select("o_orderkey", "swdep")


@query("y_delay_offset", a.with_("traces") + "SELECT line, tracl, (tracl % 64 + round_even((delrt - min(delrt) OVER (PARTITION BY line)) / 0.05::DOUBLE, 0))::BIGINT AS pick FROM traces")
def _(s, d):
    p = a.traces(s, d).withColumn("pick", F.col("tracl") % 64)
    return delays.delay_offset(p).select("line", "tracl", F.col("pick").cast("long").alias("pick"))


@query("y_static_header", _S + "SELECT line, k, round_even((a - 50) * 0.05::DOUBLE * 1000, 0)::INT AS static_header, -1000 AS static_scalar FROM series")
def _(s, d):
    t = a.series(s, d).withColumns({"static": F.col("a") - 50, "dt": F.lit(0.05)})
    return delays.static_header(t, "static", "dt").select("line", "k", "static_header", "static_scalar")


@query("y_time_axis", "SELECT p_partkey, unnest(range(p_size + 1))::INT AS i, round(p_partkey % 100 + unnest(range(p_size + 1)) * 0.05::DOUBLE, 5) AS twt FROM part")
def _(s, d):
    """An axis for each part, as long as its size."""
    from ..operators.binning import time_axis

    start = (F.col("p_partkey") % 100).cast("double")
    return a.table(s, d, "part").select("p_partkey", F.posexplode(time_axis(start, start + (F.col("p_size") + 1) * F.lit(0.05), F.lit(0.05))).alias("i", "twt"))


@query("y_mask", a.with_("cube") + "SELECT il, xl, least(fold * 3, 1)::INT AS mask FROM cube")
def _(s, d):
    from ..operators.binning import mask

    return a.cube(s, d).select("il", "xl", mask(F.col("fold") * 3).cast("int").alias("mask"))


@query("y_islands", "WITH g AS (SELECT event_id, event_id // 1000 AS block, event_id - row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS k FROM events WHERE value > 50) SELECT block, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY block, k HAVING count(*) >= 3")
def _(s, d):
    e = a.table(s, d, "events").withColumn("block", F.floor(F.col("event_id") / 1000))
    return delays.depressions(e, "block", "event_id", F.col("value") > 50).select("block", "first", "last", "n")


@query("y_gap_fill", _S + "SELECT line, k, k % 5 = 0 AS filled, round(CASE WHEN k % 5 = 0 THEN (lag(a) OVER w + lead(a) OVER w) / 2 ELSE a END, 6) + 0 AS a FROM (SELECT *, max(CASE WHEN k % 5 <> 0 THEN k END) OVER (PARTITION BY line) AS top FROM series) WINDOW w AS (PARTITION BY line ORDER BY k)")
def _(s, d):
    x = a.series(s, d)
    top = F.max("k").over(Window.partitionBy("line"))
    x = x.withColumn("top", top)
    kept = x.where((F.col("k") % 5 != 0)).select("line", "k", "a")
    filled = windows.gap_fill(kept, ["line"], "k", ["a"])
    # a last number that divides by 5 has nothing behind it and stays out of the filled range
    last = x.where((F.col("k") % 5 == 0) & (F.col("k") == F.col("top"))).select("line", "k", F.lit(None).cast("double").alias("a"), F.lit(True).alias("filled"))
    return rounded(filled.select("line", "k", "filled", "a").unionByName(last), "a")


# --- J: thresholds and projections

_TH = "round(CASE WHEN abs(amp) < 0.1 THEN 0 ELSE {} END, 6) + 0"
for _kind, _y in (("hard", "amp"), ("soft", "amp * greatest(1 - 0.1::DOUBLE / abs(amp), 0)"), ("garrote", "amp * greatest(1 - 0.01::DOUBLE / (amp * amp), 0)")):

    def _j3(s, d, kind=_kind):
        t = layouts.to_samples(a.traces(s, d)).select("line", "tracl", "i", "amp")
        return t.select("line", "tracl", "i", r(thresholds.threshold(F.col("amp"), F.lit(0.1), kind)).alias("amp"))

    query(f"j3_threshold_{_kind}", a.with_("traces", "samples") + f"SELECT line, tracl, i, {_TH.format(_y)} AS amp FROM samples")(_j3)

    def _j5(s, d, kind=_kind):
        t = layouts.to_samples(a.traces(s, d)).select("line", "tracl", "i", "amp")
        q = t.groupBy("line", "tracl").agg(F.round(F.percentile(F.abs("amp"), 0.8), 9).alias("tau"))
        return t.join(q, ["line", "tracl"]).select("line", "tracl", "i", r(thresholds.threshold(F.col("amp"), F.col("tau"), f"{kind}-percentile")).alias("amp"))

    _yq = {"hard": "amp", "soft": "amp * greatest(1 - q / abs(amp), 0)", "garrote": "amp * greatest(1 - q * q / (amp * amp), 0)"}[_kind]
    query(f"j5_threshold_{_kind}_percentile", a.with_("traces", "samples") + f"SELECT line, tracl, i, round(CASE WHEN abs(amp) < q THEN 0 ELSE {_yq} END, 6) + 0 AS amp FROM samples JOIN (SELECT line, tracl, round(quantile_cont(abs(amp), 0.8), 9) AS q FROM samples GROUP BY line, tracl) USING (line, tracl)")(_j5)


@query("j3_threshold_complex", a.with_("traces", "samples", more="z AS (SELECT line, tracl, i, amp AS re, amp * 0.5::DOUBLE AS im, sqrt(amp * amp + amp * amp * 0.25::DOUBLE) AS m FROM samples)") + "SELECT line, tracl, i, round(CASE WHEN m < 0.1 THEN 0 ELSE re * (1 - 0.1::DOUBLE / m) END, 6) + 0 AS re, round(CASE WHEN m < 0.1 THEN 0 ELSE im * (1 - 0.1::DOUBLE / m) END, 6) + 0 AS im FROM z")
def _(s, d):
    t = layouts.to_samples(a.traces(s, d))
    z = thresholds.threshold_complex(F.struct(F.col("amp").alias("re"), (F.col("amp") * 0.5).alias("im")), F.lit(0.1), "soft")
    return t.select("line", "tracl", "i", r(z["re"]).alias("re"), r(z["im"]).alias("im"))


@query(
    "j2_threshold_decay",
    "SELECT p_partkey, round(0.99 - (0.99 - 0.001) * (k - 1) / 19.0::DOUBLE, 9) AS linear, round(0.99 * exp(ln(0.001 / 0.99) * (k - 1) / 19.0::DOUBLE), 9) AS exponential, round(0.99 * exp(ln(0.001 / 0.99) * pow((k - 1) / 19.0::DOUBLE, 2)), 9) AS exponential_2, round(20 * 0.989 / 19 / k + (0.99 - 20 * 0.989 / 19), 9) + 0 AS inverse FROM (SELECT p_partkey, p_size % 20 + 1 AS k FROM part)".replace("0.989", "0.989::DOUBLE").replace("0.99 ", "0.99::DOUBLE "),
)
def _(s, d):
    m = lambda x: thresholds.decay(x, 20, 0.99, 0.001)
    at = lambda name, model: r(F.get(m(model), (F.col("p_size") % 20).cast("int")), 9).alias(name)
    return a.table(s, d, "part").select("p_partkey", at("linear", "linear"), at("exponential", "exponential"), at("exponential_2", "exponential-2"), at("inverse", "inverse_proportional"))


@query("j11_number_of_scales", "SELECT p_partkey, greatest(1, floor(0.5 * log2(greatest(p_size * 7, 12))))::INT AS n FROM part")
def _(s, d):
    return a.table(s, d, "part").select("p_partkey", thresholds.number_of_scales(F.col("p_size") * 7, F.lit(12)).alias("n"))


def pocs_slices(s, d, **options):
    """The sparse cube, its slices filled: slice, il, xl, amp, niter."""
    c = a.cube(s, d)
    n_il, n_xl = a.extent(c)
    mask = pocs.mask_of(c, n_il, n_xl)
    long = layouts.to_samples(c).select("il", "xl", "i", (F.col("amp") * F.col("fold")).alias("amp"))
    out = pocs.interpolate_cube(long, n_il, n_xl, mask, **options)
    return rounded(layouts.from_slices(out, more=["niter"]), "amp", digits=4)


@query("j1_pocs_fft")
def _(s, d):
    return pocs_slices(s, d, niter=20)


@query("j1_pocs_bands")
def _(s, d):
    """As j1_pocs_fft with fewer steps, but no task holds a slice: bands of 4 rows, strips of 64 columns."""
    c = a.cube(s, d)
    shape = bands.Shape(*a.extent(c), 4, 64)
    long = layouts.to_samples(c).select("il", "xl", "i", (F.col("amp") * F.col("fold")).alias("amp"))
    out = bands.interpolate(bands.to_bands(long, shape), bands.mask_of(c, shape), shape, niter=5)
    return rounded(bands.from_bands(out, shape).join(out.select("slice", "niter").distinct(), "slice").select("slice", "il", "xl", "amp", "niter"), "amp", digits=4)


@query("j1_pocs_fast")
def _(s, d):
    return pocs_slices(s, d, niter=20, version="fast")


@query("j1_pocs_adaptive_soft")
def _(s, d):
    return pocs_slices(s, d, niter=20, version="adaptive", alpha=0.8, thresh_op="soft", thresh_model="linear")


@query("j1_pocs_wavelet")
def _(s, d):
    return pocs_slices(s, d, niter=10, transform="WAVELET", thresh_op="soft")


@query("j1_pocs_shearlet")
def _(s, d):
    return pocs_slices(s, d, niter=5, transform="SHEARLET", thresh_op="soft")


@query("j1_pocs_curvelet")
def _(s, d):
    return pocs_slices(s, d, niter=5, transform="CURVELET")


@query("j1_pocs_shearlet_windows")
def _(s, d):
    """Each window of the frame has its own thresholds, with the floor that weighs scales."""
    return pocs_slices(s, d, niter=5, transform="SHEARLET", thresh_op="soft", thresh_model="linear", p_min="adaptive", per_window=True)


@query("j1_pocs_keeps_data", a.with_("cube", more="c AS (SELECT il, xl, fold, unnest(range(len(s)))::INT AS i, unnest(s) AS amp FROM cube)") + "SELECT i::BIGINT AS slice, il, xl, round(amp, 4) + 0 AS amp FROM c WHERE fold = 1")
def _(s, d):
    kept = a.cube(s, d).where("fold = 1").select("il", "xl")
    return pocs_slices(s, d, niter=5).join(kept, ["il", "xl"], "left_semi").select("slice", "il", "xl", "amp")


# --- K: geometry

_A = geometry.Affine.build(scaling=(2, 0.5), translation=(10, -3), rotation=30)


def _affine_sql(m: geometry.Affine, x: str = "x", y: str = "y") -> str:
    return f"round({m.a!r}::DOUBLE * {x} + {m.b!r}::DOUBLE * {y} + {m.c!r}::DOUBLE, 6) + 0 AS u, round({m.d!r}::DOUBLE * {x} + {m.e!r}::DOUBLE * {y} + {m.f!r}::DOUBLE, 6) + 0 AS v"


for _name, _m in (
    ("k2_build", _A),
    ("k7_scaling", geometry.Affine().scaled((2, 3))),
    ("k8_translation", geometry.Affine().translated((5, -7))),
    ("k9_rotation", geometry.Affine().rotated(12)),
    ("k10_rotate_around", geometry.Affine().rotated(45, (25, 4))),
    ("k12_shear", geometry.Affine().skewed((10, 5))),
    ("k14_product", geometry.Affine().rotated(20) @ geometry.Affine().scaled(2) @ geometry.Affine().translated(1)),
):

    def _k(s, d, m=_m):
        u, v = m.columns(F.col("x"), F.col("y"))
        return a.points(s, d).select("line", "tracl", r(u).alias("u"), r(v).alias("v"))

    query(_name, a.with_("points") + f"SELECT line, tracl, {_affine_sql(_m)} FROM points")(_k)


@query("k17_inverse", a.with_("points") + "SELECT line, tracl, round(x, 6) AS u, round(y, 6) + 0 AS v FROM points")
def _(s, d):
    p = a.points(s, d)
    u, v = _A.columns(F.col("x"), F.col("y"))
    x, y = _A.inverse().columns(F.col("u"), F.col("v"))
    return p.select("line", "tracl", u.alias("u"), v.alias("v")).select("line", "tracl", r(x).alias("u"), r(y).alias("v"))


@query("k4_significant", "SELECT event_id, round_even(value * pow(10, 5 - floor(log10(value))), 0) / pow(10, 5 - floor(log10(value))) AS v FROM events WHERE value > 0")
def _(s, d):
    from ..functions.units import significant

    return a.table(s, d, "events").where("value > 0").select("event_id", significant(F.col("value")).alias("v"))


@query("k19_extent_points", a.with_("points", more="e AS (SELECT line, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY line)") + "SELECT line, i, CASE WHEN i < 2 THEN x0 ELSE x1 END AS x, CASE WHEN i IN (1, 2) THEN y1 ELSE y0 END AS y FROM e, (VALUES (0), (1), (2), (3)) t(i)")
def _(s, d):
    e = a.points(s, d).groupBy("line").agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))])
    p = geometry.points_from_extent(*[F.col(c) for c in ("x0", "x1", "y0", "y1")])
    return e.select("line", F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in p])).alias("i", "p")).select("line", "i", "p.x", "p.y")


@query("k20_extents", a.with_("points") + "SELECT line, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points GROUP BY line")
def _(s, d):
    return geometry.extent_of(a.points(s, d), "line")


_POLY = a.with_(
    "nav",
    more="""p AS (SELECT line, tracl, x, y FROM nav), e AS (SELECT line, x AS x0, y AS y0, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1 FROM p WINDOW w AS (PARTITION BY line ORDER BY tracl)),
g AS (SELECT line, sum(x0 * y1 - x1 * y0) AS s, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy FROM e GROUP BY line)""",
)


@query("k21_polygon_area", _POLY + "SELECT line, round(abs(s) / 2, 3) AS area FROM g")
def _(s, d):
    p = geometry.polygons(a.nav(s, d), "line", "tracl")
    return p.select("line", r("area", 3).alias("area"))


@query("k22_polygon_centroid", _POLY + "SELECT line, round(sx / (3 * s), 4) + 0 AS cx, round(sy / (3 * s), 4) + 0 AS cy FROM g WHERE abs(s) > 1000")
def _(s, d):
    p = geometry.polygons(a.nav(s, d), "line", "tracl").where("area > 500")
    return p.select("line", r("cx", 4).alias("cx"), r("cy", 4).alias("cy"))


@query("k23_coords_to_bins", a.with_("points") + "SELECT line, tracl, round((y - 0.5) / 1 + 1, 6) + 0 AS il, round((x - 2.5) / 5 + 1, 6) + 0 AS xl FROM points")
def _(s, d):
    m = geometry.coords_to_bins(0, 50, 0, 8, 1, 5)
    il, xl = m.columns(F.col("x"), F.col("y"))
    return a.points(s, d).select("line", "tracl", r(il).alias("il"), r(xl).alias("xl"))


@query("k24_adjust_extent", a.with_("points") + "SELECT line, round(lo - (ceil(round((hi - lo) / 2.5, 9)) * 2.5 - (hi - lo)) / 2, 6) + 0 AS low, round(hi + (ceil(round((hi - lo) / 2.5, 9)) * 2.5 - (hi - lo)) / 2, 6) + 0 AS high FROM (SELECT line, min(x) AS lo, max(x) AS hi FROM points GROUP BY line)".replace("2.5", "2.5::DOUBLE"))
def _(s, d):
    e = geometry.extent_of(a.points(s, d), "line")
    lo, hi = geometry.adjusted(F.col("xmin"), F.col("xmax"), 2.5)
    return e.select("line", r(lo).alias("low"), r(hi).alias("high"))


@query("k26_bins", a.with_("cube", "grid") + "SELECT il::INT AS il, xl::INT AS xl, round((xl - 1) * 5 + 2.5, 6) AS x, round((il - 1) * 1 + 0.5, 6) AS y FROM n, range(1, ni + 1) a(il), range(1, nx + 1) b(xl)".replace("2.5", "2.5::DOUBLE").replace("0.5", "0.5::DOUBLE"))
def _(s, d):
    """Bins for the extent of the cube."""
    n_il, n_xl = a.extent(a.cube(s, d))
    return rounded(geometry.bins(s, n_il, n_xl, geometry.coords_to_bins(0, 5 * n_xl, 0, n_il, 1, 5)), "x", "y")


@query("k26_trace_bins", a.with_("points") + "SELECT line, tracl, round_even(y - 0.2::DOUBLE + 1, 0)::INT AS il, round_even((x - 2.3::DOUBLE) / 5 + 1, 0)::INT AS xl FROM points")
def _(s, d):
    return geometry.trace_bins(a.points(s, d), geometry.coords_to_bins(-0.2, 49.8, -0.3, 7.7, 1, 5)).select("line", "tracl", "il", "xl")


@query("k26_subsampled", a.with_("cube") + "SELECT ((il - 1) // 2 + 1)::INT AS il, ((xl - 1) // 3 + 1)::INT AS xl, fold FROM cube WHERE (il - 1) % 2 = 0 AND (xl - 1) % 3 = 0")
def _(s, d):
    return geometry.subsampled(a.cube(s, d).select("il", "xl", "fold"), 2, 3)


# --- L: header texts

_TEXT = "t AS (SELECT doc_id, rpad(substr(regexp_replace(text, '[^ -~]', ' ', 'g'), 1, 3200), 3200, ' ') AS t FROM documents)"


def _texts(s, d):
    return a.table(s, d, "documents").select("doc_id", F.rpad(F.substring(F.regexp_replace("text", "[^ -~]", " "), 1, 3200), 3200, " ").alias("t"))


@query("l1_wrap", f"WITH {_TEXT} SELECT doc_id, i::INT AS i, substr(t, i * 80 + 1, 80) AS line FROM t, range(40) r(i)")
def _(s, d):
    return _texts(s, d).select("doc_id", F.posexplode(headers.wrap(F.col("t"))).alias("i", "line"))


@query("l2_blank_positions", f"WITH {_TEXT} SELECT doc_id, i::INT AS i FROM t, range(80) r(i) WHERE substr(t, i + 1, 1) = ' '")
def _(s, d):
    return _texts(s, d).select("doc_id", F.explode(F.transform(headers.blank_positions(F.substring("t", 1, 80)), lambda i: i.cast("int"))).alias("i"))


@query("l3_empty_line", f"WITH {_TEXT} SELECT doc_id, min(i)::INT AS i FROM t LEFT JOIN range(40) r(i) ON trim(substr(t, i * 80 + 4, 77)) = '' GROUP BY doc_id")
def _(s, d):
    return _texts(s, d).select("doc_id", headers.empty_line(headers.wrap(F.col("t"))).alias("i"))


@query("l4_lines_starting", f"WITH {_TEXT} SELECT doc_id, i::INT AS i FROM t, range(40) r(i) WHERE starts_with(ltrim(substr(t, i * 80 + 4, 77)), 'th')")
def _(s, d):
    return _texts(s, d).select("doc_id", F.explode(headers.lines_starting(headers.wrap(F.col("t")), "th")).alias("i"))


@query("l5_line_with", f"WITH {_TEXT} SELECT doc_id, min(i)::INT AS i FROM t LEFT JOIN range(40) r(i) ON contains(substr(t, i * 80 + 1, 80), 'tion') GROUP BY doc_id")
def _(s, d):
    return _texts(s, d).select("doc_id", headers.line_with(headers.wrap(F.col("t")), "tion").alias("i"))


@query("l6_title", f"WITH {_TEXT} SELECT doc_id, sum(length(line))::BIGINT AS n, max(CASE WHEN i = 24 THEN line END) AS title FROM (SELECT doc_id, i, CASE WHEN i = 24 THEN substr(t, i * 80 + 1, 3) || repeat(' ', 23) || '{headers.TITLE}' || repeat(' ', 23) ELSE substr(t, i * 80 + 1, 80) END AS line FROM t, range(40) r(i)) GROUP BY doc_id")
def _(s, d):
    t = _texts(s, d).withColumn("l", headers.set_title(headers.wrap(F.col("t"))))
    return t.select("doc_id", F.length(F.array_join("l", "")).cast("long").alias("n"), F.get("l", F.lit(24)).alias("title"))


@query("l7_add_info", f"WITH {_TEXT} SELECT doc_id, rpad(substr(t, 25 * 80 + 1, 3) || ' 2024-01-01: STATIC (30)', 80, ' ') AS line FROM t")
def _(s, d):
    t = _texts(s, d).withColumn("w", headers.wrap(F.col("t"))).withColumn("l", headers.set_title(F.col("w")))
    return t.withColumn("l", headers.add_info(F.col("l"), "STATIC (30)", "2024-01-01")).select("doc_id", F.get("l", F.lit(25)).alias("line"))


@query("l8_ascii", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", headers.is_ascii(F.col("text")).alias("ascii"))


@query("a8_valid_header", f"WITH {_TEXT} SELECT doc_id, strlen(t) = 3200 AS ok FROM t")
def _(s, d):
    return _texts(s, d).select("doc_id", headers.is_valid(F.col("t")).alias("ok"))


@query("y_history_lines", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events")
def _(s, d):
    l1 = F.when(F.col("event_id") % 3 == 0, "C26 2024-01-05: STATIC").otherwise("C26 no date: x")
    return a.table(s, d, "events").select("event_id", F.size(headers.history(F.array(l1, F.lit("C27 text")))).alias("n"))


@query("n13_clean_log", "SELECT event_id, event_type || ' done' AS text FROM events")
def _(s, d):
    coloured = F.concat(F.lit("\x1b[31m"), F.col("event_type"), F.lit("\x1b[0m done"))
    return a.table(s, d, "events").select("event_id", headers.without_colours(coloured).alias("text"))


@query("y_renamed_interval", "SELECT o_orderkey, concat('cube_', o_orderkey, '_1+0ms.nc') AS name FROM orders")
def _(s, d):
    return a.table(s, d, "orders").select("o_orderkey", headers.renamed_interval(F.format_string("cube_%d_0+05ms.nc", "o_orderkey"), "1+0").alias("name"))


@query("n2_clip_values", a.with_("traces", "samples") + "SELECT line, round(quantile_cont(amp, 0.975), 6) + 0 AS clip FROM samples GROUP BY line")
def _(s, d):
    return layouts.to_samples(a.traces(s, d)).groupBy("line").agg(r(F.percentile("amp", 0.975)).alias("clip"))


@query("n3_difference", a.with_("traces", "samples") + "SELECT line, tracl, i, round(amp - greatest(-0.1::DOUBLE, least(0.1::DOUBLE, amp)), 6) + 0 AS amp FROM samples")
def _(s, d):
    t = a.traces(s, d).withColumn("e", amplitudes.clip(F.col("samples"), -0.1, 0.1))
    return rounded(t.select("line", "tracl", F.posexplode(F.zip_with("samples", "e", lambda x, y: x - y)).alias("i", "amp")), "amp")


@query("m16_gain_options", "SELECT p_partkey, o.name AS name, o.value AS value FROM (SELECT p_partkey, unnest([{'name': 'agc_kind', 'value': CASE WHEN p_partkey % 2 = 0 THEN 'rms' ELSE 'mean' END}, {'name': 'linear', 'value': printf('(%d.0, %d.0)', p_size, p_partkey % 9)}, {'name': 'tpow_value', 'value': printf('%d.0', p_partkey % 5)}]) AS o FROM part)")
def _(s, d):
    """Option texts made of columns, parsed."""

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = [(key, k, str(v)) for key, size in zip(p["p_partkey"], p["p_size"], strict=True) for k, v in sorted(amplitudes.parse_gain([f"tpow={key % 5}", f"linear={size},{key % 9}", f"agc_kind={'mean' if key % 2 else 'rms'}"]).items())]
            yield pd.DataFrame(rows, columns=["p_partkey", "name", "value"])

    return a.table(s, d, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, name string, value string")
