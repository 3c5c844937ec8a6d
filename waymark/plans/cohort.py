"""Queries about cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import DAY, HOUR, as_fraction, ceil_div, fahrenheit_to_celsius, hash_fraction, micros, parse_capped
from ..operators import assembly as A
from ..operators import cohort as C
from ..operators import windows as W
from ..operators.grid import landmark_grid
from .fixtures import KMAX, STEP, intervals, origins, point_events, sql, stays, table
from .fixtures import grid as grid_of

R6 = lambda c: F.round(c, 6).alias(c)


def grid(spark, d):
    g = landmark_grid(origins(point_events(spark, d)).withColumn("start", F.col("t0") + 5 * 3_600_000_000 * (F.col("key") % 4)), STEP, KMAX, 11, start="start", stop="last")
    return g.select("key", "k", "t", "k0", "main")


def first_landmark(spark, d):
    first = grid_of(spark, d).groupBy("key").agg(F.min("k").alias("k"), F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return first


def episode_origin(spark, d):
    o = C.episode_origin(point_events(spark, d), (F.col("var") == "purchase") & (F.col("value") > 50))
    return o.select("key", F.floor(F.col("t0") / 1_000_000).alias("t0_s"), "event_id", "n_qualifying", "status")


def _candidates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 90 + 10).alias("age"))
    return stays(spark, d).join(c, "key")


def index_cohort(spark, d):
    """The first order of each customer by day, priority, balance and number; out if it is open or urgent, the customer in debt, or a large line of theirs shipped in the 90 days before it."""
    li = table(spark, d, "lineitem").where("l_quantity > 45").join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), F.col("l_orderkey") == F.col("o_orderkey")).select("key", micros("l_shipdate").alias("e"))
    c = W.exists_flags(_candidates(spark, d).withColumn("t", F.col("start")), li, {"large_before": F.lit(True)}, 90 * DAY)
    flags = {"no_end": F.col("stop").isNull(), "urgent": F.col("unit") == "1-URGENT", "in_debt": F.col("c_acctbal") < 0, "large_before": F.col("large_before")}
    return C.index_cohort(c, 18, flags, ("start", "unit", "stop", "stay_id"))


def temporal_split(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    s = C.temporal_split(o, F.col("year"), {"train": [1995, 1996, 1997], "valid": [1998, 1999], "test": [2000]})
    return s.groupBy("set_name", "year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_subjects"))


def baseline_static(spark, d):
    s = stays(spark, d)
    index = s.select("key", "stay_id", "start")
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("stay_id"), "o_totalprice").join(s.select("stay_id", "start"), "stay_id")
    return C.baseline(index, h, "o_totalprice").select("key", "stay_id", "n_prior", R6("last_value"), "has_prior")


def landmark_context(spark, d):
    g, e, iv = grid_of(spark, d), point_events(spark, d), intervals(spark, d)
    x = C.landmark_context(g, {"weight": (e.where("var = 'view'"), None), "height": (e.where("var = 'login'"), 96 * HOUR)}, iv, {"drug_on": F.col("var") == "purchase", "vent_on": F.col("var") == "click"}, STEP)
    extreme = F.coalesce((F.col("weight") < 5) | (F.col("weight") > 95), F.lit(False))
    return x.select("key", "k", R6("weight"), R6("height"), "drug_on", "vent_on", extreme.alias("extreme"), "height_missing")


def capped_parse(spark, d):
    text = F.when(F.col("p_size") > 45, "> 45").when(F.col("p_size") % 7 == 0, F.concat(F.lit("about "), F.col("p_size"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    value, capped = parse_capped(text, "> 45", 46)
    return table(spark, d, "part").select("p_partkey", value.alias("size"), capped.alias("capped"))


def code_map(spark, d):
    codes = spark.createDataFrame([("A", "returned"), ("R", "returned"), ("N", "kept")], "code string, concept string")
    li = table(spark, d, "lineitem").where(F.col("l_quantity").isNotNull() & (F.col("l_quantity") > 0))
    return C.map_codes(li.withColumnRenamed("l_returnflag", "code"), codes).groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


def unit_convert(spark, d):
    e = point_events(spark, d)
    return e.select("event_id", F.round(F.when(F.col("var") == "view", fahrenheit_to_celsius(F.col("value"))).when(F.col("var") == "click", as_fraction(F.col("value"))).otherwise(F.col("value")), 6).alias("converted"))


def _texts(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 100).alias("key"), F.col("doc_id").alias("e"), "text"), table(spark, d, "part").select((F.col("p_partkey") % 100).alias("key"), F.col("p_partkey").alias("e"), F.col("p_name").alias("text"))


def ilike_evidence(spark, d):
    docs, parts = _texts(spark, d)
    return C.evidence([("documents", docs, "text"), ("parts", parts, "text")], {"ing": ["thing", "ering"], "que": ["que", "QUI"], "num": ["1", "7"]})


NOTED = "thing|ering (the|of)|[0-9]{3,}|que [a-z]+ le"


def regex_flag(spark, d):
    """Whether a text of each key, up to the key's first landmark, matches a pattern."""
    docs, parts = _texts(spark, d)
    first = (F.col("key") * 3 + F.greatest(F.lit(0), ceil_div(F.col("key") * 5 - F.col("key") * 3, 6)) * 6).alias("until")
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key")).select("key", first)
    return C.noted_before(keys, docs.unionByName(parts), "text", NOTED)


def track_membership(spark, d):
    e = point_events(spark, d)
    return C.track_membership({v: e.where((F.col("var") == v) & (F.col("value") > 85)) for v in ("click", "error", "view")})


def random_group(spark, d):
    o = table(spark, d, "orders").withColumn("set_name", F.when(F.year("o_orderdate") <= 1997, "train").otherwise("test"))
    g = C.random_group(o, hash_fraction(F.col("o_custkey"), F.lit(13)), 0.3, F.col("set_name") == "train")
    return g.groupBy("set_name", "chosen").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_subjects"))


def hash_sample(spark, d):
    return C.sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.md5(F.concat_ws(":", "o_orderkey", F.lit("7")).cast("binary")), 50)


def surrogate_ids(spark, d):
    return C.numbered(point_events(spark, d).select("key", "e", "var", "event_id"), "key", ["e", "var", "event_id"])


def static_frame(spark, d):
    """At each landmark of a user: the context there, and the baseline of the user's first order."""
    s = stays(spark, d)
    first = s.groupBy("key").agg(F.max_by("stay_id", F.struct("start", "stay_id")).alias("stay_id"), F.max("start").alias("start"))
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("stay_id"), "o_totalprice").join(s.select("stay_id", "start"), "stay_id")
    base = C.baseline(first, h, "o_totalprice").select("key", "n_prior", R6("last_value"))
    return A.static_frame(grid_of(spark, d).select("key", "k"), landmark_context(spark, d).select("key", "k", "weight", "drug_on"), base)


def renamed_keys(spark, d):
    return A.renamed(grid_of(spark, d).select("key", "k"), {"key": "episode_key"})


QUERIES = {f.__name__: f for f in (grid, first_landmark, episode_origin, index_cohort, temporal_split, baseline_static, landmark_context, static_frame, renamed_keys, capped_parse, code_map, unit_convert, ilike_evidence, regex_flag, track_membership, random_group, hash_sample, surrogate_ids)}

_DOCS = "d AS (SELECT doc_id % 100 AS key, doc_id AS e, text, 'documents' AS source FROM documents UNION ALL SELECT p_partkey % 100, p_partkey, p_name, 'parts' FROM part)"
_LAST = "{n} AS (SELECT g.key, g.k, round(arg_max(value, (e, event_id)), 6) AS {n} FROM grid g JOIN ev ON ev.key = g.key AND var = '{v}' AND e <= t {w} GROUP BY g.key, g.k)"
ORACLES = {
    "regex_flag": f"""WITH n AS (SELECT doc_id % 100 AS key, doc_id AS e, text FROM documents UNION ALL SELECT p_partkey % 100, p_partkey, p_name FROM part),
k AS (SELECT key, key * 3 + greatest(0, CAST(ceil((key * 5 - key * 3) / 6.0) AS BIGINT)) * 6 AS until FROM (SELECT c_custkey AS key FROM customer))
SELECT key, until, EXISTS (SELECT 1 FROM n WHERE n.key = k.key AND e <= until AND regexp_matches(lower(coalesce(text, '')), '{NOTED}')) AS noted FROM k""",
    "grid": sql(
        "ev", more="o AS (SELECT key, min(e) AS t0, max(e) AS last_e, min(e) + 18000000000 * (key % 4) AS start FROM ev GROUP BY key), g AS (SELECT *, t0 + k * 21600000000 AS t, CAST(greatest(0, ceil((start - t0) / 21600000000.0)) AS BIGINT) AS k0 FROM o, (SELECT unnest(generate_series(0, 27)) AS k))",
        body="SELECT key, k, t, k0, k <= 11 AS main FROM g WHERE k >= k0 AND t < last_e",
    ),
    "first_landmark": sql("ev", "grid", body="SELECT key, min(k) AS k, min(t) AS t, count(*) AS n FROM grid GROUP BY key"),
    "episode_origin": sql("ev", body="SELECT key, CAST(floor(min(e) FILTER (q) / 1000000.0) AS BIGINT) AS t0_s, arg_min(event_id, (e, event_id)) FILTER (q) AS event_id, count(*) FILTER (q) AS n_qualifying, CASE count(*) FILTER (q) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'first_of_many' END AS status FROM (SELECT *, var = 'purchase' AND value > 50 AS q FROM ev) GROUP BY key"),
    "index_cohort": sql(
        "stays", more="""c AS (SELECT s.*, c_acctbal, c_custkey % 90 + 10 AS age, row_number() OVER (PARTITION BY key ORDER BY start NULLS LAST, unit NULLS LAST, stop NULLS LAST, stay_id) AS rn FROM stays s JOIN customer ON key = c_custkey WHERE c_custkey % 90 + 10 >= 18),
li AS (SELECT o_custkey AS key, epoch_us(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45), f AS (SELECT *, EXISTS (SELECT 1 FROM li WHERE li.key = c.key AND e < start AND e >= start - 7776000000000) AS large_before FROM c WHERE rn = 1)""",
        body="SELECT key, stay_id, start, age, stop IS NULL AS no_end, unit = '1-URGENT' AS urgent, c_acctbal < 0 AS in_debt, large_before, NOT (stop IS NULL OR unit = '1-URGENT' OR c_acctbal < 0 OR large_before) AS included FROM f",
    ),
    "temporal_split": "SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN 'train' WHEN year(o_orderdate) BETWEEN 1998 AND 1999 THEN 'valid' WHEN year(o_orderdate) = 2000 THEN 'test' ELSE 'excluded' END AS set_name, year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_custkey) AS n_subjects FROM orders GROUP BY 1, 2",
    "baseline_static": sql(
        "stays", more="h AS (SELECT s.key, s.stay_id, s.start, o_totalprice FROM stays s JOIN orders ON o_orderkey = stay_id), a AS (SELECT i.key, i.stay_id, count(h.stay_id) AS n, arg_max(o_totalprice, (h.start, h.stay_id)) AS v FROM stays i LEFT JOIN h ON i.key = h.key AND h.start < i.start GROUP BY 1, 2)",
        body="SELECT key, stay_id, n AS n_prior, round(v, 6) AS last_value, n > 0 AS has_prior FROM a",
    ),
    "static_frame": sql(
        "ev", "grid", "iv", "stays", more=_LAST.format(n="weight", v="view", w="") + """, o AS (SELECT g.key, g.k, bool_or(var = 'purchase') AS drug_on FROM grid g JOIN iv ON iv.key = g.key AND start <= t AND stop > t GROUP BY g.key, g.k),
h AS (SELECT s.key, s.stay_id, s.start, o_totalprice, max(s.start) OVER (PARTITION BY s.key) AS last_start FROM stays s JOIN orders ON o_orderkey = stay_id),
b AS (SELECT key, count(*) FILTER (start < last_start) AS n_prior, round(arg_max(o_totalprice, (start, stay_id)) FILTER (start < last_start), 6) AS last_value FROM h GROUP BY key)""",
        body="SELECT g.key, g.k, weight, coalesce(drug_on, false) AS drug_on, n_prior, last_value FROM grid g LEFT JOIN weight w ON g.key = w.key AND g.k = w.k LEFT JOIN o ON g.key = o.key AND g.k = o.k LEFT JOIN b ON g.key = b.key",
    ),
    "renamed_keys": sql("ev", "grid", body="SELECT key AS episode_key, k FROM grid"),
    "landmark_context": sql(
        "ev", "grid", "iv", more=_LAST.format(n="weight", v="view", w="") + ", " + _LAST.format(n="height", v="login", w="AND e > t - 345600000000") + ", o AS (SELECT g.key, g.k, bool_or(var = 'purchase') AS drug_on, bool_or(var = 'click') AS vent_on FROM grid g JOIN iv ON iv.key = g.key AND start <= t AND stop > t GROUP BY g.key, g.k)",
        body="SELECT g.key, g.k, weight, height, coalesce(drug_on, false) AS drug_on, coalesce(vent_on, false) AS vent_on, coalesce(weight < 5 OR weight > 95, false) AS extreme, height IS NULL AS height_missing FROM grid g LEFT JOIN weight w ON g.key = w.key AND g.k = w.k LEFT JOIN height h ON g.key = h.key AND g.k = h.k LEFT JOIN o ON g.key = o.key AND g.k = o.k",
    ),
    "capped_parse": "SELECT p_partkey, CASE WHEN p_size > 45 THEN 46 WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size, p_size > 45 AS capped FROM part",
    "code_map": "SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'returned' ELSE 'kept' END AS concept, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem WHERE l_quantity > 0 AND l_returnflag IN ('A', 'R', 'N') GROUP BY 1",
    "unit_convert": "SELECT event_id, round(CASE event_type WHEN 'view' THEN (value - 32.0) * 5.0 / 9.0 WHEN 'click' THEN CASE WHEN value > 1.5 THEN value / 100.0 ELSE value END ELSE value END, 6) AS converted FROM events",
    "ilike_evidence": sql(more=_DOCS + ", x AS (SELECT *, 'ing' AS concept FROM d WHERE text ILIKE '%thing%' OR text ILIKE '%ering%' UNION ALL SELECT *, 'que' FROM d WHERE text ILIKE '%que%' OR text ILIKE '%qui%' UNION ALL SELECT *, 'num' FROM d WHERE text LIKE '%1%' OR text LIKE '%7%')", body="SELECT key, concept, arg_min(source, (e, source)) AS source, min(e) AS first_e, count(*) AS n_evidence FROM x GROUP BY key, concept"),
    "track_membership": sql("ev", more="t AS (SELECT DISTINCT key, var FROM ev WHERE value > 85 AND var IN ('click', 'error', 'view'))", body="SELECT key, string_agg(var, '+' ORDER BY var) AS tracks, count(*) AS n_tracks, CASE count(*) WHEN 3 THEN 'all' WHEN 2 THEN 'several' ELSE 'single' END AS rule FROM t GROUP BY key"),
    "random_group": "SELECT CASE WHEN year(o_orderdate) <= 1997 THEN 'train' ELSE 'test' END AS set_name, year(o_orderdate) <= 1997 AND ('0x' || substr(md5(o_custkey || ':13'), 1, 8))::BIGINT / 4294967296.0 < 0.3 AS chosen, count(*) AS n, count(DISTINCT o_custkey) AS n_subjects FROM orders GROUP BY 1, 2",
    "hash_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || ':7') LIMIT 50",
    "surrogate_ids": sql("ev", body="SELECT key, e, var, event_id, row_number() OVER (PARTITION BY key ORDER BY e, var, event_id) AS n FROM ev"),
}
