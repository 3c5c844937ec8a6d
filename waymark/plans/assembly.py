"""Queries that assemble tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import HOUR, MINUTE
from ..operators import assembly as A
from ..operators import cohort as C
from ..operators import pairing as P
from ..operators import windows as W
from .fixtures import STEP, grid, intervals, point_events, scored, sql, stays, table


def code_prefixes(spark, d):
    p = spark.createDataFrame([(1, "Brand#1", "one"), (1, "Brand#13", "thirteen"), (2, "Brand#2", "two"), (2, "Brand#", "any")], "version int, prefix string, concept string")
    x = A.has_prefix(table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 3).cast("int").alias("version")), "p_brand", "version", p)
    return x.select("p_partkey", F.array_join("concepts", ",").alias("concepts"))


def time_if_member(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format(A.time_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderdate")), "yyyy-MM-dd").alias("urgent_on"))


def text_semi_join(spark, d):
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.upper(F.trim("n_name")).alias("n"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(names, F.upper("n_name") == F.col("n"), "left_semi").select("s_suppkey", "n_name")


def rebased_minutes(spark, d):
    iv = intervals(spark, d).select(F.col("event_id").alias("stay_id"), "key", F.floor((F.col("stop") - F.col("start")) / MINUTE).alias("offset"), F.floor(F.col("start") / MINUTE).alias("stay_offset"))
    first = iv.groupBy("key").agg(F.min("stay_offset").alias("episode_offset"))
    origins = iv.join(first, "key").select("stay_id", "stay_offset", "episode_offset")
    return A.rebased(iv.select("stay_id", "offset"), origins, "offset").select("stay_id", "minute")


def per_order(spark, d):
    return A.collapsed(table(spark, d, "lineitem"), ["l_orderkey"], ["l_quantity", "l_returnflag"], F.col("l_returnflag") == "R")


def aligned_scores(spark, d):
    s = scored(spark, d)
    a, b = s.select("id", "y", "score"), s.where("id % 50 <> 0").select("id", F.when(F.col("id") % 40 == 7, 1 - F.col("y")).otherwise(F.col("y")).alias("y"), F.col("score_b").alias("score"))
    return A.aligned(a, b, ["id"], "y", "score")[1]


def first_discordant(spark, d):
    e = point_events(spark, d)
    a = W.earliest_pair(W.paired(e.where("var = 'purchase'"), e.where("var = 'error'"), 72 * HOUR, 24 * HOUR))
    b = W.earliest_pair(W.paired(e.where("var = 'purchase'"), e.where("var = 'error'"), 36 * HOUR, 24 * HOUR))
    return A.discordant(a, b, ["id_a"], "id_b", 40)


def regular_steps(spark, d):
    g = grid(spark, d)
    gaps = g.where("not (key % 10 = 0 and k = 3)").withColumn("t", F.col("t") + F.when((F.col("key") % 10 == 1) & (F.col("k") % 9 == 5), 1).otherwise(0))
    return A.steps_of(gaps, STEP).select("key", "k")


def _cohort(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 90 + 10).alias("age"))
    return C.index_cohort(stays(spark, d).join(c, "key"), 18, {"open": F.col("stop").isNull()})


def master_index(spark, d):
    split = table(spark, d, "customer").where("c_custkey % 5 <> 4").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("set_name"))
    return A.master_index(grid(spark, d), _cohort(spark, d), split).select("key", "k", "stay_id", "set_name")


def modality_index(spark, d):
    g, e = grid(spark, d), point_events(spark, d)
    selected = W.as_of(g, e.where("var = 'login'"), ["event_id"], 48 * HOUR).where("event_id is not null").select("key", "k", "event_id")
    passed = e.where("var = 'login'").select("event_id", (F.col("value") > 30).alias("passed"))
    return A.modality_index(g.select("key", "k"), selected, passed, "event_id").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("usable").cast("long")).alias("n_usable"))


def mapped_schema(spark, d):
    return A.mapped(table(spark, d, "supplier"), {"id": ("s_suppkey", "bigint"), "segment": (None, "string"), "balance": ("s_acctbal", "double"), "size": ("not_there", "double"), "name": ("s_name", "string")})


def exclusive_columns(spark, d):
    s = stays(spark, d).select("stay_id", F.when(F.col("stay_id") % 3 == 0, 1).alias("x"), F.when(F.col("stay_id") % 5 == 0, 1).alias("y"), F.when(F.col("stay_id") % 3 == 1, 1).alias("z"))
    return s.groupBy(A.exclusive(s, ["x", "y", "z"]).alias("exclusive")).agg(F.count(F.lit(1)).alias("n"))


def contract_events(spark, d):
    e = point_events(spark, d)
    contract = spark.createDataFrame([("chart", "view", "known"), ("chart", "click", "event"), ("other", "login", "known")], "source string, var string, clock string")
    w = A.whitelisted({"chart": e.where("var <> 'login'"), "other": e.where("var in ('login', 'error')")}, contract)
    return w.groupBy("source", "var", "clock").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def open_evidence_removed(spark, d):
    """Logins that no closed stay of the key contains."""
    e = point_events(spark, d).where("var = 'login'").select("event_id", "key", "e")
    return P.inside_any(e, stays(spark, d), closed=False).where("not inside").select("event_id", "key")


def normalised_kinds(spark, d):
    """Each text, its accents taken apart and put together again."""
    t = F.col("text")
    for letter, apart in (("\u00e9", "e\u0301"), ("\u00fc", "u\u0308"), ("\u00f1", "n\u0303")):
        t = F.regexp_replace(t, letter, apart)
    return table(spark, d, "documents").select("doc_id", A.normalised(t).alias("kind"))


def paired_subset(spark, d):
    e = point_events(spark, d)
    return P.restrict(e.where("var = 'view'"), e.where("var = 'error' and value > 95"), ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (code_prefixes, time_if_member, text_semi_join, rebased_minutes, per_order, aligned_scores, first_discordant, regular_steps, master_index, modality_index, mapped_schema, exclusive_columns, contract_events, open_evidence_removed, normalised_kinds, paired_subset)
}

_PAIR = "SELECT x.event_id AS id_a, arg_min(y.event_id, (y.e, y.event_id)) AS v FROM ev x JOIN ev y ON x.key = y.key AND x.var = 'purchase' AND y.var = 'error' AND x.e - y.e BETWEEN -86400000000 AND {b} GROUP BY x.event_id"
ORACLES = {
    "code_prefixes": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 2 THEN 'any' END, CASE WHEN p_partkey % 3 = 1 AND p_brand LIKE 'Brand#1%' THEN 'one' END, CASE WHEN p_partkey % 3 = 1 AND p_brand LIKE 'Brand#13%' THEN 'thirteen' END, CASE WHEN p_partkey % 3 = 2 AND p_brand LIKE 'Brand#2%' THEN 'two' END) AS concepts FROM part",
    "time_if_member": "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN strftime(o_orderdate, '%Y-%m-%d') END AS urgent_on FROM orders",
    "text_semi_join": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE upper(n_name) IN (SELECT upper(trim(n_name)) FROM nation WHERE n_regionkey < 3)",
    "rebased_minutes": sql("iv", body="SELECT event_id AS stay_id, CAST(floor(start / 60000000.0) + floor((stop - start) / 60000000.0) - min(floor(start / 60000000.0)) OVER (PARTITION BY key) AS BIGINT) AS minute FROM iv"),
    "per_order": "SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, bool_or(l_returnflag = 'R') AS any_positive, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey",
    "aligned_scores": """WITH a AS (SELECT event_id AS id, (value > 60)::INT AS y FROM events), b AS (SELECT event_id AS id, CASE WHEN event_id % 40 = 7 THEN 1 - (value > 60)::INT ELSE (value > 60)::INT END AS y FROM events WHERE event_id % 50 <> 0),
 c AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS n_both, count(*) FILTER (a.y <> b.y) AS n_other_label FROM a JOIN b ON a.id = b.id) SELECT *, n_a = n_b AND n_a = n_both AND n_other_label = 0 AS aligned FROM c""",
    "first_discordant": sql("ev", more=f"a AS ({_PAIR.format(b=72 * HOUR)}), b AS ({_PAIR.format(b=36 * HOUR)})", body="SELECT coalesce(a.id_a, b.id_a) AS id_a, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.id_a = b.id_a WHERE a.v IS DISTINCT FROM b.v ORDER BY 1 LIMIT 40"),
    "regular_steps": sql("ev", "grid", more="g AS (SELECT key, k, t + CASE WHEN key % 10 = 1 AND k % 9 = 5 THEN 1 ELSE 0 END AS t FROM grid WHERE NOT (key % 10 = 0 AND k = 3)), s AS (SELECT *, lag(k) OVER w AS pk, lag(t) OVER w AS pt FROM g WINDOW w AS (PARTITION BY key ORDER BY k))", body="SELECT key, k FROM s WHERE k - pk <> 1 OR t - pt <> 21600000000"),
    "master_index": sql(
        "ev", "grid", "stays", more="c AS (SELECT s.key, s.stay_id, stop, row_number() OVER (PARTITION BY s.key ORDER BY start NULLS LAST, stay_id) AS rn FROM stays s JOIN customer ON s.key = c_custkey WHERE c_custkey % 90 + 10 >= 18)",
        body="SELECT g.key, g.k, stay_id, CASE WHEN g.key % 5 = 4 THEN 'excluded' WHEN g.key % 5 = 0 THEN 'test' ELSE 'train' END AS set_name FROM grid g JOIN c ON g.key = c.key AND rn = 1 AND stop IS NOT NULL",
    ),
    "modality_index": sql("ev", "grid", more="x AS (SELECT g.key, g.k, arg_max(value, (e, event_id)) AS v FROM grid g LEFT JOIN ev ON ev.key = g.key AND var = 'login' AND e <= t AND e > t - 172800000000 GROUP BY g.key, g.k)", body="SELECT k, count(*) AS n, count(*) FILTER (v > 30) AS n_usable FROM x GROUP BY k"),
    "mapped_schema": "SELECT s_suppkey AS id, 'Unknown' AS segment, s_acctbal AS balance, NULL::DOUBLE AS size, s_name AS name FROM supplier",
    "exclusive_columns": "SELECT (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 3 = 1)::INT <= 1 AS exclusive, count(*) AS n FROM orders GROUP BY 1",
    "contract_events": sql("ev", more="w AS (SELECT CASE WHEN var = 'login' THEN 'other' ELSE 'chart' END AS source, var, CASE WHEN var = 'click' THEN 'event' ELSE 'known' END AS clock, CASE WHEN var = 'click' THEN e ELSE a END AS moment FROM ev WHERE var IN ('view', 'click', 'login'))", body="SELECT source, var, clock, count(*) AS n, min(moment) AS first_at, max(moment) AS last_at FROM w GROUP BY ALL"),
    "open_evidence_removed": sql("ev", "stays", body="SELECT event_id, key FROM ev WHERE var = 'login' AND NOT EXISTS (SELECT 1 FROM stays s WHERE s.key = ev.key AND start <= e AND stop > e)"),
    "normalised_kinds": "SELECT doc_id, nfc_normalize(text) AS kind FROM documents",
    "paired_subset": sql("ev", body="SELECT key, count(*) AS n FROM ev WHERE var = 'view' AND key IN (SELECT key FROM ev WHERE var = 'error' AND value > 95) GROUP BY key"),
}
