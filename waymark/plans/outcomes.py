"""Queries about outcomes, scores and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import DAY, HOUR
from ..operators import outcomes as O
from ..operators import windows as W
from .fixtures import STEP, VARIABLES, WIDTH, grid, point_events, sql, table

R6 = lambda c: F.round(c, 6).alias(c)


def _next(spark, d):
    """At each landmark the next purchase, error and login of certain events, and the key's last event."""
    e, g = point_events(spark, d), grid(spark, d)
    kinds = {n: (F.col("var") == v) & (F.col("event_id") % 5 == i) for i, (n, v) in enumerate({"death": "purchase", "transfer": "error", "alive_discharge": "login"}.items())}
    last = e.groupBy("key").agg(F.max("e").alias("last_seen"), F.max(F.when(F.col("var") == "click", F.col("e"))).alias("last_click"))
    n = O.next_after(g, e, kinds).join(last, "key")
    died = F.col("death").isNotNull().cast("int")
    seen = F.when(F.col("key") % 5 == 3, None).when(F.col("key") % 4 == 0, F.col("last_click")).otherwise(F.col("last_seen"))
    return n.select("key", "k", "t", (F.col("t") + WIDTH).alias("w_end"), F.when(F.col("key") % 7 == 0, 1 - died).otherwise(died).alias("died"), F.when(F.col("key") % 17 == 0, F.col("t")).otherwise(F.col("death")).alias("death"), "transfer", "alive_discharge", seen.alias("last_seen"), (F.col("key") % 9 == 0).alias("seen_after"))


def observation_endpoint(spark, d):
    e = point_events(spark, d)
    limits = e.groupBy("key").agg(F.when(F.col("key") % 5 != 0, F.min("e") + 40 * DAY).alias("limit"))
    o = O.observation_end({v: e.where((F.col("var") == v) & (F.col("key") % 7 != 0)) for v in VARIABLES}, limits, ["click", "view"])
    return o.select("key", F.floor(F.col("observed_until") / 1_000_000).alias("until_s"), "end_source", "last_source", "after_limit")


def label_24h(spark, d):
    return O.label_states(_next(spark, d)).select("key", "k", "state", "y", "status", "ascertainable", "full_followup", "unknown_reason")


def label_reason_dist(spark, d):
    return O.label_states(_next(spark, d)).groupBy("k", "state").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_known"))


def competing_7d(spark, d):
    c = O.competing_risk(_next(spark, d), 7 * DAY)
    return c.select("key", "k", "cause", F.round((F.col("at") - F.col("t")) / F.lit(float(HOUR)), 6).alias("hours"), "censor_type")


def event_time_bins(spark, d):
    c = O.competing_risk(_next(spark, d), 7 * DAY)
    return c.select("key", "k", "cause", O.event_bin(F.col("at"), F.col("t"), F.col("cause"), 12 * HOUR, 14).alias("bin"))


def adjudication_queue(spark, d):
    return O.adjudication_queue(O.label_states(_next(spark, d))).select("key", "k", "state", "adjudication")


def _measures():
    """Stand-ins for measurements, by kind of event."""
    v = lambda name: F.when(F.col("var") == name, F.col("value"))
    return {
        "ratio": (F.min, v("view") * 5), "supported": (F.max, F.when(F.col("var") == "login", True)), "platelets": (F.min, v("click") * 3), "bilirubin": (F.max, v("login") / 8), "pressure": (F.min, v("view")),
        "drug_a": (F.max, F.floor(v("purchase") / 5)), "drug_b": (F.max, v("error")), "drug_c": (F.max, F.floor(v("purchase") / 10) / 100), "drug_d": (F.max, F.floor(v("login") / 20) / 40),
        "alertness": (F.min, F.floor(v("login") / 6)), "creatinine": (F.max, v("click") / 20), "urine": (F.sum, v("error") * 10),
    }


DAY_BACK = (-24 * HOUR, 0)


def _scored_tracks(spark, d, tracks):
    """The score at each landmark, on tracks that look at some inputs within other hours than 24."""
    inputs, g = _measures(), grid(spark, d)
    most = max(-low for v in tracks.values() for low, _ in [DAY_BACK, *v.values()])
    w = W.point_window(point_events(spark, d), g, most, STEP)
    return O.organ_scores(O.measured(w, ["key", "k"], inputs, {t: {n: own.get(n, DAY_BACK) for n in inputs} for t, own in tracks.items()}, "track"))


def organ_ladders(spark, d):
    return _scored_tracks(spark, d, {"strict_24h": {}}).select("key", "k", "resp", "coag", "liver", "cardio", "neuro", "renal")


def organ_total_mask(spark, d):
    return _scored_tracks(spark, d, {"strict_24h": {}}).groupBy("missing", "n_known").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("mean_total"), F.max("total").alias("max_total"))


def organ_tracks(spark, d):
    """The score on two tracks: everything within 24 hours, or laboratory values carried forward for 48."""
    x = _scored_tracks(spark, d, {"strict_24h": {}, "carryforward": {n: (-48 * HOUR, 0) for n in ("platelets", "bilirubin", "creatinine")}})
    return x.select("key", "k", "track", "resp", "coag", "liver", "cardio", "neuro", "renal", "n_known", "missing", F.array_join("reasons", ",").alias("reasons"), "status", "total")


def score_delta(spark, d):
    """From each user's first error above 20 (the evidence), the score of (t - 48 h, t - 24 h] against that of (t - 24 h, t + 48 h], with drugs by existence and the kidney by creatinine alone."""
    e = point_events(spark, d)
    origin = e.where("var = 'error' and value > 20").groupBy("key").agg(F.min("e").alias("t"))
    inputs = {n: x for n, x in _measures().items() if n in ("ratio", "supported", "platelets", "bilirubin", "pressure", "alertness", "creatinine")}
    inputs |= {"any_drug": (F.max, F.when((F.col("var") == "purchase") & (F.col("value") > 40), True)), "urine": (F.max, F.lit(None).cast("double"))}
    spans = {"baseline": (-48 * HOUR, -24 * HOUR), "qualifying": (-24 * HOUR, 48 * HOUR)}
    scores = O.organ_scores(O.measured(e.join(origin, "key"), ["key"], inputs, {w: dict.fromkeys(inputs, span) for w, span in spans.items()}), any_drug="any_drug")
    return O.score_rise(scores, ["key"])


def _fingerprinted(spark, d):
    i = F.col("event_id")
    place = F.struct((i % 2).alias("b"), F.array("event_type", F.lit(None).cast("string")).alias("a"))
    e = table(spark, d, "events").select(F.when(i % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("kind"), F.col("user_id").alias("user"), F.when(i % 11 != 0, F.col("props")).alias("props"), (i % 4 / 4).cast("decimal(5,2)").alias("amount"), place.alias("place"))
    return O.canonical_ids(e, ["user", "kind", "props", "amount", "place"], ["kind"])


def canonical_id(spark, d):
    return O.dedup_counts(_fingerprinted(spark, d))


def dedup_conservation(spark, d):
    f = _fingerprinted(spark, d)
    c = O.dedup_counts(f).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_canonical"), F.sum("n_variants").alias("n_variants"))
    return c.crossJoin(f.agg(F.count(F.lit(1)).alias("n_source"))).select("*", (F.col("n_rows") == F.col("n_source")).alias("conserved"))


def unified_sources(spark, d):
    li = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("key"), F.col("p_partkey").alias("event_id"), F.col("p_partkey").alias("e"), "p_brand")
    return O.unify([("first", li, ["1", "3"]), ("second", li, ["#2", "BRAND#4"])], "p_brand").select("key", "event_id", "source")


def unified_chains(spark, d):
    e = point_events(spark, d).withColumn("text", F.concat_ws(" ", "var", "kind"))
    return O.unify_chains([("first", e, ["purchase", "error"]), ("second", e.where("var <> 'purchase'"), ["stored"])], "text", 20 * HOUR).select("key", "chain", "event_id", "n_merged", "first_e")


def source_coverage_rollup(spark, d):
    return O.coverage(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity") > 10, 0.8)


QUERIES = {f.__name__: f for f in (observation_endpoint, label_24h, label_reason_dist, competing_7d, event_time_bins, adjudication_queue, organ_ladders, organ_total_mask, organ_tracks, score_delta, canonical_id, dedup_conservation, unified_sources, unified_chains, source_coverage_rollup)}

_NEXT = """n0 AS (SELECT g.key, g.k, g.t, min(e) FILTER (var = 'purchase' AND e > t AND event_id % 5 = 0) AS death, min(e) FILTER (var = 'error' AND e > t AND event_id % 5 = 1) AS transfer, min(e) FILTER (var = 'login' AND e > t AND event_id % 5 = 2) AS alive_discharge, max(e) AS last_e, max(e) FILTER (var = 'click') AS last_click FROM grid g JOIN ev ON g.key = ev.key GROUP BY ALL),
n AS (SELECT key, k, t, t + 86400000000 AS w_end, CASE WHEN key % 7 = 0 THEN 1 - (death IS NOT NULL)::INT ELSE (death IS NOT NULL)::INT END AS died, CASE WHEN key % 17 = 0 THEN t ELSE death END AS death, transfer, alive_discharge, CASE WHEN key % 5 = 3 THEN NULL WHEN key % 4 = 0 THEN last_click ELSE last_e END AS last_seen, key % 9 = 0 AS seen_after FROM n0)"""
_STATE = """lab AS (SELECT *, CASE WHEN death IS NOT NULL AND death <= t THEN 'invalid_input' WHEN death IS NOT NULL AND died = 0 THEN 'status_conflict' WHEN died = 1 AND death IS NULL THEN 'death_time_missing' WHEN death > t AND death <= w_end THEN 'event'
 WHEN transfer > t AND transfer <= w_end THEN 'acute_transfer' WHEN alive_discharge > t AND alive_discharge <= w_end THEN 'non_event_alive_discharge' WHEN last_seen >= w_end THEN 'non_event_observed' ELSE 'missing_status_left_observation' END AS state FROM n),
s2 AS (SELECT *, CASE WHEN state = 'event' THEN 1 WHEN state IN ('non_event_observed', 'non_event_alive_discharge') THEN 0 END AS y FROM lab)"""
_RISK = """r0 AS (SELECT *, t + 604800000000 AS fin FROM n), risk AS (SELECT *, CASE WHEN death > t AND death <= fin THEN 1 WHEN transfer > t AND transfer <= fin THEN 3 WHEN alive_discharge > t AND alive_discharge <= fin THEN 2 ELSE 0 END AS cause FROM r0),
cr AS (SELECT *, CASE cause WHEN 1 THEN death WHEN 3 THEN transfer WHEN 2 THEN alive_discharge ELSE least(fin, coalesce(last_seen, fin)) END AS moment, CASE WHEN cause = 0 AND last_seen < fin THEN 'left_observation' ELSE 'window_end' END AS censor_type FROM risk)"""
_PARTS = """CASE WHEN ratio IS NULL THEN NULL WHEN ratio < 100 AND supported THEN 4 WHEN ratio < 200 AND supported THEN 3 WHEN ratio < 300 THEN 2 WHEN ratio < 400 THEN 1 ELSE 0 END AS resp, CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2 WHEN platelets < 150 THEN 1 WHEN platelets IS NOT NULL THEN 0 END AS coag,
 CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1 WHEN bilirubin IS NOT NULL THEN 0 END AS liver, {cardio} AS cardio,
 CASE WHEN alertness < 6 THEN 4 WHEN alertness < 10 THEN 3 WHEN alertness < 13 THEN 2 WHEN alertness < 15 THEN 1 WHEN alertness IS NOT NULL THEN 0 END AS neuro,
 {renal} AS renal"""
_PRESSURE = "CASE WHEN pressure < 70 THEN 1 WHEN pressure IS NOT NULL THEN 0 END"
_CREATININE = "CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 WHEN creatinine IS NOT NULL THEN 0 END"
_FULL = _PARTS.format(
    cardio=f"greatest({_PRESSURE}, CASE WHEN da > 15 THEN 4 WHEN da > 5 THEN 3 WHEN da > 0 THEN 2 END, CASE WHEN db > 0 THEN 2 END, CASE WHEN dc > 0.1::DOUBLE THEN 4 WHEN dc > 0 THEN 3 END, CASE WHEN dd > 0.1::DOUBLE THEN 4 WHEN dd > 0 THEN 3 END)",
    renal=f"greatest({_CREATININE}, CASE WHEN urine < 200 THEN 4 WHEN urine < 500 THEN 3 WHEN urine IS NOT NULL THEN 0 END)",
)
_EXISTS = _PARTS.format(cardio=f"greatest({_PRESSURE}, CASE WHEN any_drug THEN 2 END)", renal=_CREATININE)


def _track(labs: int) -> str:
    """Inputs at each landmark, laboratory values within some hours."""
    near, lab = "e > t - 86400000000", f"e > t - {labs * HOUR}"
    return f"""SELECT ev.key, g.k, min(value) FILTER (var = 'view' AND {near}) * 5 AS ratio, bool_or(var = 'login' AND {near}) AS supported, min(value) FILTER (var = 'click' AND {lab}) * 3 AS platelets, max(value) FILTER (var = 'login' AND {lab}) / 8 AS bilirubin, min(value) FILTER (var = 'view' AND {near}) AS pressure, floor(max(value) FILTER (var = 'purchase' AND {near}) / 5) AS da,
 max(value) FILTER (var = 'error' AND {near}) AS db, floor(max(value) FILTER (var = 'purchase' AND {near}) / 10) / 100 AS dc, floor(max(value) FILTER (var = 'login' AND {near}) / 20) / 40 AS dd, floor(min(value) FILTER (var = 'login' AND {near}) / 6) AS alertness, max(value) FILTER (var = 'click' AND {lab}) / 20 AS creatinine, sum(value) FILTER (var = 'error' AND {near}) * 10 AS urine
 FROM ev JOIN grid g ON ev.key = g.key AND e <= t AND e > t - {{width}} GROUP BY ev.key, g.k"""


_IN = f"i AS ({_track(24).format(width=24 * HOUR)}), o AS (SELECT key, k, {_FULL} FROM i)"
_MASK = " || ".join(f"({c} IS NULL)::INT" for c in ("resp", "coag", "liver", "cardio", "neuro", "renal"))
_JSON = """sha256('{"user":' || user_id || ',"kind":' || to_json(%s) || ',"props":' || coalesce(to_json(props)::VARCHAR, 'null') || ',"amount":' || ['0', '0.25', '0.5', '0.75'][event_id %% 4 + 1] || ',"place":{"a":[' || to_json(event_type) || ',null],"b":' || event_id %% 2 || '}}')"""
_FP = f"""f AS (SELECT {_JSON % 'kind'} AS raw_id, {_JSON % 'lower(trim(kind))'} AS canonical_id
 FROM (SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS kind, CASE WHEN event_id % 11 <> 0 THEN props END AS props FROM events)),
c AS (SELECT canonical_id, count(*) AS n_rows, count(DISTINCT raw_id) AS n_variants FROM f GROUP BY canonical_id)"""
ORACLES = {
    "observation_endpoint": sql(
        "ev", more="""o AS (SELECT key, CASE WHEN key % 5 <> 0 THEN min(e) + 3456000000000 END AS lim, max(e) FILTER (var IN ('click', 'view') AND key % 7 <> 0) AS last_e, arg_max(var, (e, var)) FILTER (var IN ('click', 'view') AND key % 7 <> 0) AS last_source FROM ev GROUP BY key)""",
        body="SELECT key, CAST(floor(least(last_e, lim) / 1000000.0) AS BIGINT) AS until_s, CASE WHEN lim IS NOT NULL AND (last_e IS NULL OR lim <= last_e) THEN 'discharge' WHEN last_e IS NOT NULL THEN 'clinical_event' ELSE 'unknown' END AS end_source, last_source, coalesce(last_e > lim, false) AS after_limit FROM o",
    ),
    "label_24h": sql(
        "ev", "grid", more=f"{_NEXT}, {_STATE}",
        body="""SELECT key, k, state, y, CASE y WHEN 1 THEN 'event' WHEN 0 THEN 'non_event' ELSE 'unknown' END AS status, y IS NOT NULL AS ascertainable, state = 'non_event_observed' OR (state = 'non_event_alive_discharge' AND alive_discharge >= w_end) AS full_followup,
 CASE WHEN state = 'missing_status_left_observation' AND seen_after THEN 'time_anomaly' WHEN y IS NULL THEN state END AS unknown_reason FROM s2""",
    ),
    "label_reason_dist": sql("ev", "grid", more=f"{_NEXT}, {_STATE}", body="SELECT k, state, count(*) AS n, count(y) AS n_known FROM s2 GROUP BY k, state"),
    "competing_7d": sql("ev", "grid", more=f"{_NEXT}, {_RISK}", body="SELECT key, k, cause, round((moment - t) / 3600000000.0, 6) AS hours, censor_type FROM cr"),
    "event_time_bins": sql("ev", "grid", more=f"{_NEXT}, {_RISK}", body="SELECT key, k, cause, CASE WHEN cause = 0 THEN 14 ELSE CAST(least(greatest(ceil((moment - t) / 43200000000.0), 1), 14) AS INT) END AS bin FROM cr"),
    "adjudication_queue": sql("ev", "grid", more=f"{_NEXT}, {_STATE}", body="SELECT key, k, state, 'pending' AS adjudication FROM lab WHERE state IN ('status_conflict', 'death_time_missing', 'invalid_input')"),
    "organ_ladders": sql("ev", "grid", more=_IN, body="SELECT * FROM o"),
    "organ_total_mask": sql("ev", "grid", more=_IN, body=f"SELECT {_MASK} AS missing, 6 - (length({_MASK}) - length(replace({_MASK}, '1', ''))) AS n_known, count(*) AS n, round(avg(resp + coag + liver + cardio + neuro + renal), 6) AS mean_total, max(resp + coag + liver + cardio + neuro + renal) AS max_total FROM o GROUP BY 1, 2"),
    "organ_tracks": sql(
        "ev", "grid", more=f"i1 AS ({_track(24).format(width=48 * HOUR)}), i2 AS ({_track(48).format(width=48 * HOUR)}), o AS (SELECT key, k, 'strict_24h' AS track, {_FULL} FROM i1 UNION ALL SELECT key, k, 'carryforward', {_FULL} FROM i2), m AS (SELECT *, {_MASK} AS missing FROM o), n AS (SELECT *, length(replace(missing, '1', '')) AS n_known FROM m)",
        body="SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{r}' END" for c, r in O.REASONS.items()) + ") AS reasons, CASE WHEN n_known = 6 THEN 'complete_6_of_6' ELSE 'partial_' || n_known || '_of_6' END AS status, resp + coag + liver + cardio + neuro + renal AS total FROM n",
    ),
    "score_delta": sql(
        "ev", more=f"""z AS (SELECT key, min(e) AS t FROM ev WHERE var = 'error' AND value > 20 GROUP BY key), w AS (SELECT key, t, 'b' AS w, t - 172800000000 AS lo, t - 86400000000 AS hi FROM z UNION ALL SELECT key, t, 'q', t - 86400000000, t + 172800000000 FROM z),
i AS (SELECT w.key, w, min(value) FILTER (var = 'view') * 5 AS ratio, bool_or(var = 'login') AS supported, min(value) FILTER (var = 'click') * 3 AS platelets, max(value) FILTER (var = 'login') / 8 AS bilirubin, min(value) FILTER (var = 'view') AS pressure, bool_or(var = 'purchase' AND value > 40) AS any_drug, floor(min(value) FILTER (var = 'login') / 6) AS alertness, max(value) FILTER (var = 'click') / 20 AS creatinine
 FROM w LEFT JOIN ev ON ev.key = w.key AND e > lo AND e <= hi GROUP BY w.key, w), o AS (SELECT key, w, {_EXISTS} FROM i),
s AS (SELECT key, w, coalesce(resp, 0) + coalesce(coag, 0) + coalesce(liver, 0) + coalesce(cardio, 0) + coalesce(neuro, 0) + coalesce(renal, 0) AS total, {' + '.join(f'({c} IS NOT NULL)::INT' for c in O.REASONS)} AS n FROM o),
p AS (SELECT b.key, b.total AS bt, b.n AS bn, q.total AS qt, q.n AS qn FROM s b JOIN s q ON b.key = q.key AND b.w = 'b' AND q.w = 'q')""",
        body="""SELECT key, CASE WHEN bn = 6 THEN bt ELSE 0 END AS baseline, CASE WHEN bn = 6 THEN 'observed_complete' ELSE 'assumed_zero_by_phenotype_rule' END AS baseline_source, bn < 6 AS assumed, bn AS baseline_known, qt AS qualifying, qn AS qualifying_known,
 CASE WHEN bn = 6 AND qn = 6 THEN qt - bt END AS delta_observed, qt - CASE WHEN bn = 6 THEN bt ELSE 0 END AS delta, qt - CASE WHEN bn = 6 THEN bt ELSE 0 END >= 2 AS qualifies FROM p""",
    ),
    "canonical_id": f"WITH {_FP} SELECT canonical_id, n_rows, n_variants FROM c",
    "dedup_conservation": f"WITH {_FP} SELECT CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_canonical, CAST(sum(n_variants) AS BIGINT) AS n_variants, (SELECT count(*) FROM f) AS n_source, sum(n_rows) = (SELECT count(*) FROM f) AS conserved FROM c",
    "unified_sources": "SELECT p_partkey % 50 AS key, p_partkey AS event_id, CASE WHEN p_brand LIKE '%1%' OR p_brand LIKE '%3%' THEN 'first' ELSE 'second' END AS source FROM part WHERE p_brand LIKE '%1%' OR p_brand LIKE '%3%' OR p_brand LIKE '%#2%' OR p_brand ILIKE '%brand#4%'",
    "unified_chains": sql(
        "ev", more="u AS (SELECT key, event_id, e, CASE WHEN var IN ('purchase', 'error') THEN 0 ELSE 1 END AS p FROM ev WHERE var IN ('purchase', 'error') OR kind = 'stored'), c AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY key ORDER BY e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY key ORDER BY e, event_id) <= 72000000000 THEN 0 ELSE 1 END AS nw FROM u))",
        body="SELECT key, chain, arg_min(event_id, (p, e, event_id)) AS event_id, count(*) AS n_merged, min(e) AS first_e FROM c GROUP BY key, chain",
    ),
    "source_coverage_rollup": "SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 10) AS n_covered, round(count(*) FILTER (l_quantity > 10) / count(*), 6) AS share, count(*) FILTER (l_quantity > 10) >= 0.8 * count(*) AS enough FROM lineitem GROUP BY ROLLUP (l_returnflag)",
}
