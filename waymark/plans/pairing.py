"""Queries that pair events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import DAY, HOUR
from ..operators import pairing as P
from ..operators import windows as W
from .fixtures import grid, intervals, point_events, sql


def _two(spark, d):
    e = point_events(spark, d)
    return e.where("var = 'purchase'"), e.where("var = 'error'")


def pair_all(spark, d):
    return W.paired(*_two(spark, d), 72 * HOUR, 24 * HOUR)


def pair_earliest(spark, d):
    return W.earliest_pair(W.paired(*_two(spark, d), 72 * HOUR, 24 * HOUR))


def pair_dual_grain(spark, d):
    a, b = _two(spark, d)
    b = b.select("key", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("e")).alias("e"), F.floor(F.col("e") / DAY).alias("day"))
    return P.dual_grain(a, b, 72 * HOUR, 24 * HOUR, DAY)


def reconcile_full_outer(spark, d):
    mine = W.earliest_pair(W.paired(*_two(spark, d), 72 * HOUR, 24 * HOUR)).select(F.col("id_a").alias("id"), F.col("id_b").alias("v"))
    theirs = W.earliest_pair(W.paired(*_two(spark, d), 48 * HOUR, 24 * HOUR)).select(F.col("id_a").alias("id"), F.col("id_b").alias("v"))
    return P.reconcile(mine, theirs, ["id"], "v")


def _starts(spark, d):
    return grid(spark, d).select("key", "k", "t")


def flag_exists_before(spark, d):
    v = F.col("var")
    return W.exists_flags(_starts(spark, d), point_events(spark, d), {"any_error": v == "error", "any_purchase": v == "purchase", "any_login": v == "login"})


def flag_lookback_90d(spark, d):
    return W.exists_flags(_starts(spark, d), point_events(spark, d), {"recent": F.col("var").isNotNull(), "recent_error": F.col("var") == "error"}, 90 * DAY)


def attribute_encounter(spark, d):
    """Views against each user's longest of a few intervals, the visit before it being some hours that depend on the user."""
    e = point_events(spark, d)
    iv = intervals(spark, d).where("event_id % 3 = 0").select("key", F.col("event_id").alias("stay_id"), "start", F.when(F.col("event_id") % 7 != 0, F.col("stop")).alias("stop"))
    index = iv.groupBy("key").agg(F.min_by(F.struct("stay_id", "start", "stop"), F.struct((F.col("start") % 1000), "start", "stay_id")).alias("i")).select("key", "i.*")
    h = F.col("key") % 4
    index = index.withColumns({"visit_start": F.when(h > 0, F.col("start") - h * 30 * HOUR), "visit_stop": F.col("start") + (h - 2) * 2 * HOUR})
    return P.attribute(e.where("var = 'view'"), index, iv, 3 * DAY, 3 * HOUR)


def select_latest(spark, d):
    e = point_events(spark, d).where("var = 'login'").select("key", "event_id", "a", (F.col("event_id") % 4 != 0).alias("valid"))
    x = P.latest_available(grid(spark, d), e, {"f24": 24 * HOUR, "f48": 48 * HOUR, "f72": 72 * HOUR}, 24 * HOUR, HOUR)
    return x.withColumn("hours_before", F.round("hours_before", 6))


QUERIES = {f.__name__: f for f in (pair_all, pair_earliest, pair_dual_grain, reconcile_full_outer, flag_exists_before, flag_lookback_90d, attribute_encounter, select_latest)}

_PAIR = "SELECT x.key, x.event_id AS id_a, y.event_id AS id_b, x.e AS e_a, y.e AS e_b FROM ev x JOIN ev y ON x.key = y.key AND x.var = 'purchase' AND y.var = 'error' AND x.e - y.e BETWEEN -86400000000 AND {b}"
_FIRST = "SELECT key, id_a, arg_min(id_b, (e_b, id_b)) AS id_b, CASE WHEN min(e_b) <= e_a THEN 'before' ELSE 'after' END AS kind FROM ({p}) GROUP BY key, id_a, e_a"
_P72, _P48 = _PAIR.format(b=72 * HOUR), _PAIR.format(b=48 * HOUR)
ORACLES = {
    "pair_all": sql("ev", body=_P72),
    "pair_earliest": sql("ev", body=_FIRST.format(p=_P72)),
    "pair_dual_grain": sql(
        "ev", more="""a AS (SELECT * FROM ev WHERE var = 'purchase'), b AS (SELECT key, event_id, CASE WHEN event_id % 3 <> 0 THEN e END AS e, CAST(floor(e / 86400000000.0) AS BIGINT) AS day FROM ev WHERE var = 'error'),
c AS (SELECT a.key, a.event_id AS id_a, b.event_id AS id_b, a.e - b.e BETWEEN 0 AND 259200000000 AS before, a.e - b.e BETWEEN -86400000000 AND 0 AS after, 'time' AS grain, b.e AS moment FROM a JOIN b ON a.key = b.key AND b.e IS NOT NULL
 UNION ALL SELECT a.key, a.event_id, b.event_id, floor(a.e / 86400000000.0) - b.day BETWEEN 0 AND 3, floor(a.e / 86400000000.0) - b.day BETWEEN -1 AND 0, 'day', b.day * 86400000000 FROM a JOIN b ON a.key = b.key AND b.e IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY key, id_a ORDER BY CASE WHEN before THEN 0 ELSE 1 END, moment, id_b) AS rn FROM c WHERE before OR after)""",
        body="SELECT a.key, a.event_id AS id_a, id_b, grain, CASE WHEN id_b IS NULL THEN 'none' WHEN before THEN 'before' ELSE 'after' END AS side FROM a LEFT JOIN r ON a.key = r.key AND a.event_id = r.id_a AND rn = 1",
    ),
    "reconcile_full_outer": sql(
        "ev", more=f"x AS (SELECT id_a AS id, id_b AS v FROM ({_FIRST.format(p=_P72)})), y AS (SELECT id_a AS id, id_b AS v FROM ({_FIRST.format(p=_P48)}))",
        body="SELECT count(*) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) AS n_both, count(*) FILTER (y.id IS NULL) AS n_left, count(*) FILTER (x.id IS NULL) AS n_right, round(avg(CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL THEN (x.v IS NOT DISTINCT FROM y.v)::INT END), 6) AS agreement FROM x FULL JOIN y ON x.id = y.id",
    ),
    "flag_exists_before": sql("ev", "grid", body="SELECT key, k, t, " + ", ".join(f"EXISTS (SELECT 1 FROM ev WHERE ev.key = grid.key AND var = '{v}' AND e < t) AS any_{v}" for v in ("error", "purchase", "login")) + " FROM grid"),
    "flag_lookback_90d": sql("ev", "grid", body="SELECT key, k, t, EXISTS (SELECT 1 FROM ev WHERE ev.key = grid.key AND e < t AND e >= t - 7776000000000) AS recent, EXISTS (SELECT 1 FROM ev WHERE ev.key = grid.key AND var = 'error' AND e < t AND e >= t - 7776000000000) AS recent_error FROM grid"),
    "attribute_encounter": sql(
        "ev", "iv", more="""s AS (SELECT key, event_id AS stay_id, start, CASE WHEN event_id % 7 <> 0 THEN stop END AS stop FROM iv WHERE event_id % 3 = 0),
i AS (SELECT *, CASE WHEN key % 4 > 0 THEN start - (key % 4) * 108000000000 END AS v0, start + (key % 4 - 2) * 7200000000 AS v1 FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY start % 1000, start, stay_id) = 1),
x AS (SELECT ev.key, ev.event_id, ev.e, i.stay_id, i.start, i.stop, v0, v1, EXISTS (SELECT 1 FROM s WHERE s.key = ev.key AND s.stay_id <> i.stay_id AND ev.e >= s.start AND ev.e <= coalesce(s.stop, ev.e)) AS other FROM ev JOIN i ON ev.key = i.key WHERE var = 'view')""",
        body="""SELECT key, event_id, stay_id, CASE WHEN e >= start AND e <= coalesce(stop, e) THEN 'same_hospitalization' WHEN e < start AND v0 IS NOT NULL AND e >= v0 AND e <= greatest(start, v1) AND abs(start - v1) <= 10800000000 AND start - e <= 259200000000 AND NOT other THEN 'auditable_pre_admission_encounter'
 WHEN other THEN 'other_encounter' ELSE 'out_of_window' END AS attribution FROM x""",
    ),
    "select_latest": sql(
        "ev", "grid", more="x AS (SELECT g.key, g.k, g.t, max(a) AS a, arg_max(event_id, (a, event_id)) AS event_id, arg_max(event_id % 4 <> 0, (a, event_id)) AS valid FROM grid g LEFT JOIN ev ON ev.key = g.key AND var = 'login' AND a <= t AND a > t - 259200000000 GROUP BY ALL)",
        body="SELECT key, k, event_id, coalesce(valid AND t - a <= 86400000000, false) AS f24, coalesce(valid AND t - a <= 172800000000, false) AS f48, coalesce(valid AND t - a <= 259200000000, false) AS f72, round((t - a) / 3600000000.0, 6) AS hours_before, CASE WHEN a IS NULL THEN 'none' WHEN NOT valid THEN 'found' WHEN t - a <= 86400000000 THEN 'available' ELSE 'stale' END AS availability FROM x",
    ),
}
