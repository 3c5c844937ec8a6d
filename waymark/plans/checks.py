"""Queries that check data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import HOUR
from ..operators import fitting as M
from ..operators import outcomes as O
from ..operators import quality as Q
from ..operators import windows as W
from .fitting import CHANNELS
from .fixtures import RETRO, STEP, STRICT, VARIABLES, WIDTH, grid, intervals, point_events, sql, stays, table

R = lambda c, n=6: F.round(c, n).alias(c)


def _windows(spark, d, clock):
    return W.point_window(point_events(spark, d), grid(spark, d), WIDTH, STEP, clock=clock)


def leakage_check(spark, d):
    """The strict window holds; the retrospective one is reported for what it is."""
    a = Q.no_leakage(_windows(spark, d, "a")).withColumn("assertion", F.lit("strict"))
    return a.unionByName(Q.no_leakage(_windows(spark, d, None)).withColumn("assertion", F.lit("retro")))


def bin_containment(spark, d):
    return Q.contained(W.hourly_bins(_windows(spark, d, "a")), HOUR)


def split_purity(spark, d):
    o = table(spark, d, "orders")
    by_year = o.select(F.col("o_custkey").alias("s"), F.year("o_orderdate").alias("set_name"))
    by_subject = o.select(F.col("o_custkey").alias("s"), (F.col("o_custkey") % 3).alias("set_name"))
    return Q.pure_split(by_subject, "s", "set_name").withColumn("assertion", F.lit("by_subject")).unionByName(Q.pure_split(by_year, "s", "set_name").withColumn("assertion", F.lit("by_year")))


def unique_check(spark, d):
    return Q.together([Q.unique("grid", grid(spark, d), ["key", "k"]), Q.unique("orders", table(spark, d, "orders"), ["o_orderkey"]), Q.unique("users", table(spark, d, "events"), ["user_id"])])


def state_space(spark, d):
    e = point_events(spark, d)
    return Q.together([Q.state_space("all", e, "var", list(VARIABLES)), Q.state_space("some", e, "var", ["click", "view", "login"])])


def schema_contract(spark, d):
    return Q.schema_contract(point_events(spark, d).withColumn("value", F.when(F.col("event_id") % 10 != 3, F.col("value"))), ["event_id", "key", "e", "a", "var", "value", "set_name"], ["key", "value"])


def row_reconcile(spark, d):
    s, o = stays(spark, d), table(spark, d, "orders")
    return Q.row_counts([("stays", s, o), ("closed_stays", s.where("stop is not null"), o)])


def mask_policy(spark, d):
    t = M.tensors(W.hourly_bins(_windows(spark, d, "a")).where(F.col("var").isin(CHANNELS)), ["key", "k"], CHANNELS, 24)
    return Q.mask_policy(t)


def keyset_equal(spark, d):
    g = grid(spark, d)
    some = _windows(spark, d, "a")
    return Q.same_keys(g, g.orderBy("t"), ["key", "k"]).withColumn("assertion", F.lit("grid")).unionByName(Q.same_keys(g, some, ["key", "k"]).withColumn("assertion", F.lit("windows")))


def fitted_on_train(spark, d):
    e = point_events(spark, d)
    return Q.fitted_on(M.fit_channels(e).unionByName(M.fit_channels(e, "validation").where("var = 'view'")))


def _profile(spark, d, odd=None):
    e = point_events(spark, d)
    return Q.profile(e.where(F.col("key") % 2 == odd) if odd is not None else e, ["var"], F.lit(2.0), F.lit(97.0))


def distribution_profile(spark, d):
    p = _profile(spark, d)
    return p.select("var", "n", *[R(c) for c in p.columns[2:]])


def distribution_grade(spark, d):
    return Q.equivalence(_profile(spark, d, 0), _profile(spark, d, 1), ["var"]).select("var", R("shift"), R("outside"), "grade")


def gates(spark, d):
    e = point_events(spark, d)
    stats = e.groupBy(F.col("var").alias("track")).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.countDistinct("key").cast("double").alias("subjects"), F.avg(F.col("value")).alias("mean"))
    long = stats.unpivot(["track"], ["rows", "subjects", "mean"], "metric", "value")
    least = spark.createDataFrame([("rows", 1990.0), ("subjects", 100.0), ("mean", 50.0)], "metric string, least double")
    return Q.gates(long, least).select("track", "metric", R("value"), "least", "pass", "go")


def cohort_flow(spark, d):
    s = stays(spark, d)
    return Q.flow(s, [("all", F.lit(True)), ("closed", F.col("stop").isNotNull()), ("not_urgent", F.col("unit") != "1-URGENT"), ("even", F.col("key") % 2 == 0)])


def hub_share(spark, d):
    return Q.largest_share(point_events(spark, d), "key").select("n_groups", "largest", R("share"))


def long_form(spark, d):
    """Wide columns to long rows, without nulls, united with another source."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"))
    long = p.unpivot(["p_partkey"], ["size", "price"], "var", "value").where("value is not null")
    other = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit("balance").alias("var"), F.col("s_acctbal").alias("value"))
    return long.unionByName(other).groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def interval_checks(spark, d):
    """Intervals that are ordered, orders of one customer, and users that are in one half only, which they are not."""
    iv, o = intervals(spark, d), table(spark, d, "orders")
    e = point_events(spark, d).withColumn("half", F.col("event_id") % 2)
    back = iv.withColumn("stop", F.when(F.col("event_id") % 9 == 0, F.col("start") - 1).otherwise(F.col("stop")))
    return Q.together([Q.ordered("ordered", iv, "start", "stop"), Q.ordered("turned_round", back, "start", "stop"), Q.within_one("order_of_one_customer", o, "o_orderkey", "o_custkey"), Q.within_one("user_in_one_half", e, "key", "half")])


def landmark_checks(spark, d):
    """Next events lie after their landmark and the latest known ones do not; with last events for next ones both fail."""
    g, e = grid(spark, d), point_events(spark, d)
    ahead = O.next_after(g, e, {"later": F.lit(True)})
    past = W.as_of(g, e, ["a"])
    return Q.together([Q.after_landmark("outcome_after", ahead, "later"), Q.until_landmark("artifact_until", past, "e"), Q.until_landmark("known_until", past, "a"), Q.after_landmark("past_after", past, "e")])


QUERIES = {
    f.__name__: f
    for f in (leakage_check, bin_containment, split_purity, unique_check, state_space, schema_contract, row_reconcile, mask_policy, keyset_equal, fitted_on_train, distribution_profile, distribution_grade, gates, cohort_flow, hub_share, long_form, interval_checks, landmark_checks)
}

_A = "SELECT '{n}' AS assertion, count(*) FILTER ({v}) = 0 AS pass, CAST(count(*) FILTER ({v}) AS VARCHAR) AS detail FROM {f}"


def _a(name: str, violation: str, source: str) -> str:
    return _A.format(n=name, v=violation, f=source)


_PR = "SELECT var, count(value) AS n, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS v_min, max(value) AS v_max, avg((value < 2 OR value > 97)::INT) AS outside FROM ev WHERE key % 2 = {o} GROUP BY var"
_PR_ALL = _PR.replace("WHERE key % 2 = {o} ", "")
ORACLES = {
    "leakage_check": sql("ev", "grid", more=STRICT + ", r" + RETRO[1:], body=f"{_a('strict', 'a > t', 'w')} UNION ALL {_a('retro', 'a > t', 'r')}"),
    "bin_containment": sql(
        "ev", "grid", more=STRICT + ", b AS (SELECT key, k, t, var, CAST(least(floor((t - e) / 3600000000.0), 23) AS BIGINT) AS bin, min(e) AS fe, max(e) AS le FROM w GROUP BY ALL)",
        body=_a("events_in_bins", "(fe <= t - (bin + 1) * 3600000000 AND bin < 23) OR le > t - bin * 3600000000", "b"),
    ),
    "split_purity": f"{_a('by_subject', 'n > 1', '(SELECT o_custkey, count(DISTINCT o_custkey % 3) AS n FROM orders GROUP BY 1)')} UNION ALL {_a('by_year', 'n > 1', '(SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1)')}",
    "unique_check": sql("ev", "grid", body=f"{_a('grid', 'n > 1', '(SELECT count(*) AS n FROM grid GROUP BY key, k)')} UNION ALL {_a('orders', 'n > 1', '(SELECT count(*) AS n FROM orders GROUP BY o_orderkey)')} UNION ALL {_a('users', 'n > 1', '(SELECT count(*) AS n FROM events GROUP BY user_id)')}"),
    "state_space": "SELECT 'all' AS assertion, count(*) = 0 AS pass, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS detail FROM events WHERE event_type NOT IN ('click', 'error', 'login', 'purchase', 'view') UNION ALL SELECT 'some', count(*) = 0, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') FROM events WHERE event_type NOT IN ('click', 'view', 'login')",
    "schema_contract": f"SELECT 'no_missing_columns' AS assertion, false AS pass, 'set_name' AS detail UNION ALL SELECT 'no_extra_columns', false, 'kind' UNION ALL {_a('required_not_null', 'user_id IS NULL OR value IS NULL OR event_id % 10 = 3', 'events')}",
    "interval_checks": sql("iv", body=f"{_a('ordered', 'stop < start', 'iv')} UNION ALL {_a('turned_round', 'CASE WHEN event_id % 9 = 0 THEN start - 1 ELSE stop END < start', 'iv')} UNION ALL {_a('order_of_one_customer', 'n > 1', '(SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderkey)')} UNION ALL {_a('user_in_one_half', 'n > 1', '(SELECT count(DISTINCT event_id % 2) AS n FROM events GROUP BY user_id)')}"),
    "landmark_checks": sql(
        "ev", "grid", more="n AS (SELECT g.key, g.k, g.t, min(e) AS later FROM grid g JOIN ev ON ev.key = g.key AND e > t GROUP BY ALL), p AS (SELECT g.key, g.k, g.t, max(e) AS e, arg_max(a, (e, event_id)) AS a FROM grid g JOIN ev ON ev.key = g.key AND e <= t GROUP BY ALL)",
        body=f"{_a('outcome_after', 'later <= t', 'n')} UNION ALL {_a('artifact_until', 'e > t', 'p')} UNION ALL {_a('known_until', 'a > t', 'p')} UNION ALL {_a('past_after', 'e <= t', 'p')}",
    ),
    "row_reconcile": sql("stays", body="SELECT 'stays' AS assertion, a = b AS pass, a || '/' || b AS detail FROM (SELECT count(*) AS a FROM stays), (SELECT count(*) AS b FROM orders) UNION ALL SELECT 'closed_stays', a = b, a || '/' || b FROM (SELECT count(stop) AS a FROM stays), (SELECT count(*) AS b FROM orders)"),
    "mask_policy": "SELECT * FROM (VALUES ('no_nan', true, '0'), ('masked_is_zero', true, '0')) v(assertion, pass, detail)",
    "keyset_equal": sql("ev", "grid", more=STRICT, body="SELECT 'grid' AS assertion, true AS pass, '' AS detail UNION ALL SELECT 'windows', NOT EXISTS (SELECT key, k FROM grid EXCEPT SELECT key, k FROM w), ''"),
    "fitted_on_train": "SELECT 'fitted_on_train' AS assertion, false AS pass, '1' AS detail",
    "distribution_profile": sql("ev", body="SELECT var, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("p1", "q1", "median", "q3", "p99", "iqr", "v_min", "v_max", "outside")) + f" FROM ({_PR_ALL})"),
    "distribution_grade": sql(
        "ev", more=f"x AS ({_PR.format(o=0)}), y AS ({_PR.format(o=1)}), z AS (SELECT x.var, abs(x.median - y.median) / greatest(abs(x.median), 1e-9) AS shift, greatest(x.outside, y.outside) AS outside FROM x JOIN y ON x.var = y.var)",
        body="SELECT var, round(shift, 6) AS shift, round(outside, 6) AS outside, CASE WHEN shift <= 0.15 AND outside <= 0.05 THEN 'A' ELSE 'B' END AS grade FROM z",
    ),
    "gates": sql("ev", more="s AS (SELECT var AS track, count(*)::DOUBLE AS rows_, count(DISTINCT key)::DOUBLE AS subjects, avg(value) AS mean FROM ev GROUP BY var), l AS (SELECT track, 'rows' AS metric, rows_ AS value, 1990.0::DOUBLE AS least FROM s UNION ALL SELECT track, 'subjects', subjects, 100.0 FROM s UNION ALL SELECT track, 'mean', mean, 50.0 FROM s)", body="SELECT track, metric, round(value, 6) AS value, least, value >= least AS pass, bool_and(value >= least) OVER (PARTITION BY track) AS go FROM l"),
    "cohort_flow": sql("stays", body=" UNION ALL ".join(f"SELECT {i} AS step_no, '{n}' AS step, count(*) AS n, count(DISTINCT key) AS n_subjects FROM stays WHERE {c}" for i, (n, c) in enumerate((("all", "true"), ("closed", "stop IS NOT NULL"), ("not_urgent", "stop IS NOT NULL AND unit <> '1-URGENT'"), ("even", "stop IS NOT NULL AND unit <> '1-URGENT' AND key % 2 = 0"))))),
    "hub_share": sql("ev", body="SELECT count(*) AS n_groups, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM ev GROUP BY key)"),
    "long_form": "SELECT 'size' AS var, count(p_size) AS n, round(sum(p_size), 2) AS total FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'price', count(p_retailprice), round(sum(p_retailprice), 2) FROM part UNION ALL SELECT 'balance', count(s_acctbal), round(sum(s_acctbal), 2) FROM supplier",
}
