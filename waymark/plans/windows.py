"""Queries over look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import HOUR
from ..operators import windows as W
from .fixtures import RETRO, STEP, STRICT, VARIABLES, WIDTH, grid, intervals, point_events, sql

R6 = lambda c: F.round(c, 6).alias(c)


def _strict(spark, d):
    g = grid(spark, d)
    return W.point_window(W.bounded(point_events(spark, d), g, WIDTH), g, WIDTH, STEP, clock="a")


def _retro(spark, d):
    return W.point_window(point_events(spark, d), grid(spark, d), WIDTH, STEP)


def strict_bins(spark, d):
    b = W.hourly_bins(_strict(spark, d))
    return b.select("key", "k", "t", "var", "bin", R6("value_median"), "n", "first_event", "last_event", "last_available", "kind", "bin_start", "bin_end")


def retro_bins(spark, d):
    b = W.hourly_bins(_retro(spark, d))
    return b.select("key", "k", "t", "var", "bin", R6("value_median"), "n", "first_event", "last_event", "last_available", "kind", "bin_start", "bin_end")


_BINS = """SELECT key, k, t, var, CAST(least(floor((t - e) / 3600000000.0), 23) AS INT) AS bin, round(median(value), 6) AS value_median, count(value) AS n, min(e) AS first_event,
 max(e) AS last_event, max(a) AS last_available, min(kind) AS kind, t - (CAST(least(floor((t - e) / 3600000000.0), 23) AS BIGINT) + 1) * 3600000000 AS bin_start,
 t - CAST(least(floor((t - e) / 3600000000.0), 23) AS BIGINT) * 3600000000 AS bin_end FROM w GROUP BY ALL"""


def bins_wide(spark, d):
    b = W.hourly_bins(_strict(spark, d))
    wide = W.pivot_wide(b, ["key", "k", "bin"], "var", list(VARIABLES), "value_median")
    return wide.select("key", "k", "bin", *[R6(v) for v in VARIABLES])


def window_summary(spark, d):
    s = W.summary(_strict(spark, d))
    return s.select("key", "k", "t", "var", *[R6(c) for c in ("v_min", "v_median", "v_max", "v_sd", "last_value", "last_age_h")], "n_obs")


_SUMMARY = """SELECT key, k, t, var, min(value) AS v_min, median(value) AS v_median, max(value) AS v_max, stddev(value) AS v_sd, count(value) AS n_obs,
 arg_max(value, (e, event_id)) AS last_value, (t - max(e)) / 3600000000.0 AS last_age_h FROM w GROUP BY key, k, t, var"""


def summary_wide(spark, d):
    wide = W.summary_wide(W.summary(_strict(spark, d)), list(VARIABLES), ["v_min", "v_median", "v_max", "v_sd", "n_obs", "last_value", "last_age_h"])
    return wide.select("key", "k", *[R6(c) for c in wide.columns[2:]])


def dual_horizon_extremes(spark, d):
    x = W.extremes(W.point_window(point_events(spark, d), grid(spark, d), 2 * WIDTH, STEP), {"24h": WIDTH, "48h": 2 * WIDTH})
    return x.select("key", "k", "var", *[R6(c) for c in x.columns[3:]])


def asof_latest(spark, d):
    g = grid(spark, d)
    views = point_events(spark, d).where("var = 'view'")
    return W.as_of(g, views, ["value"], 48 * HOUR).select("key", "k", F.round((F.col("t") - F.col("e")) / F.lit(float(HOUR)), 6).alias("age_h"), R6("value"))


def ratio_pairing(spark, d):
    e = point_events(spark, d)
    r = W.ratio_pairs(grid(spark, d), e.where("var = 'view'"), e.where("var = 'click'"), 72 * HOUR)
    return r.select("key", "k", R6("v1"), R6("v2"), R6("ratio"), R6("gap_h"), "known", "eligible")


_ASOF = "{n} AS (SELECT g.key, g.k, g.t, max(e) AS e, arg_max(value, (e, event_id)) AS value, arg_max(a, (e, event_id)) AS a FROM grid g JOIN ev ON ev.key = g.key AND var = '{v}' AND e <= t AND e > t - {w} GROUP BY ALL)"


def active_now(spark, d):
    a = W.active_at(intervals(spark, d), grid(spark, d), STEP)
    n = a.groupBy("key", "k").agg(F.count(F.lit(1)).alias("n_active"), F.round(F.max("dose"), 6).alias("max_dose"))
    return W.with_parts(grid(spark, d), [n]).select("key", "k", F.coalesce("n_active", F.lit(0)).alias("n_active"), "max_dose")


def overlap_exposure(spark, d):
    x = W.exposure(W.overlap_window(intervals(spark, d), grid(spark, d), WIDTH, STEP), WIDTH)
    return x.select("key", "k", *[R6(c) for c in ("overlap_h", "dose_h", "max_dose", "median_dose")], "n")


def flow_window(spark, d):
    f = W.flow(_retro(spark, d))
    return f.select("key", "k", R6("total"), R6("median"), R6("largest"), "n")


def exposure_rebin(spark, d):
    j = W.overlap_window(intervals(spark, d), grid(spark, d), WIDTH, STEP)
    return W.rebin_exposure(j, WIDTH).select("key", "k", "bin", R6("dose"))


def exposure_rebin_overlap(spark, d):
    j = W.overlap_window(intervals(spark, d), grid(spark, d), WIDTH, STEP)
    return W.rebin_exposure(j, WIDTH, "overlap").select("key", "k", "bin", R6("dose"))


def assembled(spark, d):
    """Aggregates of three windows joined to the grid."""
    g = grid(spark, d)
    n = W.flow(_strict(spark, d)).select("key", "k", F.col("n").alias("n_strict"))
    m = W.flow(_retro(spark, d)).select("key", "k", F.col("n").alias("n_retro"))
    x = W.exposure(W.overlap_window(intervals(spark, d), g, WIDTH, STEP), WIDTH).select("key", "k", F.round("overlap_h", 6).alias("overlap_h"))
    return W.with_parts(g, [n, m, x])


QUERIES = {f.__name__: f for f in (strict_bins, retro_bins, bins_wide, window_summary, summary_wide, dual_horizon_extremes, asof_latest, ratio_pairing, active_now, overlap_exposure, flow_window, exposure_rebin, exposure_rebin_overlap, assembled)}

_MAXCASE = ", ".join(f"max(CASE WHEN var = '{v}' THEN value_median END) AS {v}" for v in VARIABLES)
_WIDE = ", ".join(f"round(max(CASE WHEN var = '{v}' THEN {c} END), 6) AS {v}_{c}" for v in VARIABLES for c in ("v_min", "v_median", "v_max", "v_sd", "n_obs", "last_value", "last_age_h"))
_OV = "ov AS (SELECT iv.*, g.k, g.t FROM iv JOIN grid g ON iv.key = g.key AND iv.start <= g.t AND iv.stop > g.t - 86400000000)"
_OU = "greatest(0, least(stop, t) - greatest(start, t - 86400000000))"
_O = f"{_OU} / 3600000000.0"
ORACLES = {
    "strict_bins": sql("ev", "grid", more=STRICT, body=_BINS),
    "retro_bins": sql("ev", "grid", more=RETRO, body=_BINS),
    "bins_wide": sql("ev", "grid", more=STRICT, body=f"SELECT key, k, bin, {_MAXCASE} FROM ({_BINS}) GROUP BY key, k, bin"),
    "window_summary": sql("ev", "grid", more=STRICT, body=f"SELECT key, k, t, var, round(v_min, 6) AS v_min, round(v_median, 6) AS v_median, round(v_max, 6) AS v_max, round(v_sd, 6) AS v_sd, round(last_value, 6) AS last_value, round(last_age_h, 6) AS last_age_h, n_obs FROM ({_SUMMARY})"),
    "summary_wide": sql("ev", "grid", more=STRICT, body=f"SELECT key, k, {_WIDE} FROM ({_SUMMARY}) GROUP BY key, k"),
    "dual_horizon_extremes": sql(
        "ev", "grid", body="""SELECT g.key, g.k, var, round(min(CASE WHEN t - e < 86400000000 THEN value END), 6) AS min_24h, round(max(CASE WHEN t - e < 86400000000 THEN value END), 6) AS max_24h,
 round(min(value), 6) AS min_48h, round(max(value), 6) AS max_48h FROM ev JOIN grid g ON ev.key = g.key AND e <= t AND e > t - 172800000000 GROUP BY g.key, g.k, var""",
    ),
    "asof_latest": sql("ev", "grid", more=_ASOF.format(n="x", v="view", w=172800000000), body="SELECT g.key, g.k, round((g.t - x.e) / 3600000000.0, 6) AS age_h, round(x.value, 6) AS value FROM grid g LEFT JOIN x ON g.key = x.key AND g.k = x.k"),
    "ratio_pairing": sql(
        "ev", "grid", more=_ASOF.format(n="x", v="view", w=259200000000) + ", " + _ASOF.format(n="y", v="click", w=259200000000),
        body="""SELECT x.key, x.k, round(x.value, 6) AS v1, round(y.value, 6) AS v2, round(CASE WHEN y.value <> 0 THEN x.value / y.value END, 6) AS ratio, round(abs(x.e - y.e) / 3600000000.0, 6) AS gap_h,
 greatest(x.a, y.a) AS known, greatest(x.a, y.a) <= x.t AS eligible FROM x JOIN y ON x.key = y.key AND x.k = y.k""",
    ),
    "active_now": sql("ev", "grid", "iv", body="SELECT g.key, g.k, count(iv.event_id) AS n_active, round(max(dose), 6) AS max_dose FROM grid g LEFT JOIN iv ON iv.key = g.key AND start <= t AND stop > t GROUP BY g.key, g.k"),
    "overlap_exposure": sql("ev", "grid", "iv", more=_OV, body=f"SELECT key, k, round(sum({_OU}) / 3600000000.0, 6) AS overlap_h, round(sum(dose * {_O}), 6) AS dose_h, round(max(dose), 6) AS max_dose, round(median(dose), 6) AS median_dose, count(*) AS n FROM ov GROUP BY key, k"),
    "flow_window": sql("ev", "grid", more=RETRO, body="SELECT key, k, round(sum(value), 6) AS total, round(median(value), 6) AS median, round(max(value), 6) AS largest, count(value) AS n FROM w GROUP BY key, k"),
    "exposure_rebin": sql("ev", "grid", "iv", more=_OV, body="SELECT key, k, CAST(greatest(0, least(floor((t - start) / 3600000000.0), 23)) AS INT) AS bin, round(max(dose), 6) AS dose FROM ov GROUP BY 1, 2, 3"),
    "exposure_rebin_overlap": sql(
        "ev", "grid", "iv", more=_OV, body="""SELECT key, k, b AS bin, round(max(dose), 6) AS dose FROM ov, (SELECT CAST(unnest(generate_series(0, 23)) AS INT) AS b)
 WHERE b >= greatest(0, floor((t - stop) / 3600000000.0)) AND b <= greatest(greatest(0, floor((t - stop) / 3600000000.0)), least(23, floor((t - greatest(start, t - 86400000000 + 1)) / 3600000000.0))) GROUP BY key, k, b""",
    ),
    "assembled": sql(
        "ev", "grid", "iv", more=f"{STRICT}, {_OV}, a AS (SELECT key, k, count(value) AS n_strict FROM w GROUP BY key, k), b AS (SELECT ev.key, g.k, count(value) AS n_retro FROM ev JOIN grid g ON ev.key = g.key AND e <= t AND e > t - 86400000000 GROUP BY ev.key, g.k), c AS (SELECT key, k, round(sum({_OU}) / 3600000000.0, 6) AS overlap_h FROM ov GROUP BY key, k)",
        body="SELECT g.key, g.k, g.t, n_strict, n_retro, overlap_h FROM grid g LEFT JOIN a ON g.key = a.key AND g.k = a.k LEFT JOIN b ON g.key = b.key AND g.k = b.k LEFT JOIN c ON g.key = c.key AND g.k = c.k",
    ),
}
