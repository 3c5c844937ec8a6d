"""Queries that fit and apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import HOUR, hash_fraction, logit
from ..operators import assembly as A
from ..operators import fitting as M
from ..operators import outcomes as O
from ..operators import windows as W
from .fixtures import LOGIT, STEP, STRICT, WIDTH, grid, newton, point_events, scored, sql, table

R6 = lambda c: F.round(c, 6).alias(c)
CHANNELS, TENSOR_WIDTH = ["click", "view", "purchase"], 24


def _events(spark, d):
    e = point_events(spark, d).select("event_id", "key", "var", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"))
    return e, e.where("key % 3 <> 0")


def channel_scaler_fit(spark, d):
    return M.fit_channels(_events(spark, d)[1]).select("var", R6("mean"), R6("sd"), "n", "fitted_on")


def channel_scaled(spark, d):
    every, train = _events(spark, d)
    return M.scale_channels(every, M.fit_channels(train)).select("event_id", R6("scaled"))


def _parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 8 != 0, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice")
    return p, p.where("p_partkey % 4 <> 0")


def static_scaler(spark, d):
    every, train = _parts(spark, d)
    return M.scale_columns(every, M.fit_columns(train, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"]).select("p_partkey", R6("p_size_z"), R6("p_retailprice_z"))


def median_impute(spark, d):
    every, train = _parts(spark, d)
    return M.impute(every, M.fit_columns(train, ["p_size"]), ["p_size"]).select("p_partkey", R6("p_size"), "p_size_missing")


def rare_onehot(spark, d):
    every, train = _parts(spark, d)
    levels = M.fit_levels(train.withColumn("p_brand", F.when(F.col("p_partkey") % 50 == 0, None).otherwise(F.col("p_brand"))), "p_brand", 0.04)
    return M.encode_levels(every, levels, "p_brand").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def _customers(spark, d):
    """Customers with a segment that is missing for some and rare for a few."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 150 == 1, "RARE").when(k % 20 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 8 != 0, F.col("c_acctbal").cast("double")).alias("balance"), (k % 90 + 10).cast("double").alias("age"))
    return c, c.where("c_custkey % 4 <> 0")


def onehot_columns(spark, d):
    every, train = _customers(spark, d)
    x = M.one_hot(every, M.fit_levels(train, "segment", 0.02), "segment")
    return x.select("c_custkey", *x.columns[4:])


def static_matrix(spark, d):
    """Imputed, scaled and encoded, one row per customer."""
    every, train = _customers(spark, d)
    x = M.static_matrix(every, M.fit_columns(train, ["balance", "age"]), {"segment": M.fit_levels(train, "segment", 0.02)}, "c_custkey", ["balance", "age"], ["balance"])
    return x.select("c_custkey", R6("balance_z"), R6("age_z"), *x.columns[3:])


def frozen_external(spark, d):
    """Parameters fitted on customers, applied without a refit to suppliers, whose columns have other names."""
    _, train = _customers(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "OTHER").alias("segment"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal").cast("double")).alias("balance"), F.lit(None).cast("double").alias("age"))
    x = M.static_matrix(s, M.fit_columns(train, ["balance", "age"]), {"segment": M.fit_levels(train, "segment", 0.02)}, "c_custkey", ["balance", "age"], ["balance", "age"])
    return x.select(F.col("c_custkey").alias("s_suppkey"), R6("balance_z"), R6("age_z"), *x.columns[3:])


def artifact_registry(spark, d):
    _, train = _customers(spark, d)
    return M.registry({"columns": M.fit_columns(train, ["balance", "age"]).select("column", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), "fitted_on"), "levels": M.fit_levels(train, "segment", 0.02).select("level", F.round("share", 6).alias("share"), "kept", "fitted_on")})


def mad_thresholds(spark, d):
    t = M.fit_thresholds(_events(spark, d)[1].where("value is not null"), zero_inflated=("error",))
    return t.select("var", *[R6(c) for c in ("median", "mad", "low", "high")])


def qc_apply(spark, d):
    every, train = _events(spark, d)
    return M.passes(every, M.fit_thresholds(train.where("value is not null"), 1.5)).groupBy("var", "passed").agg(F.count(F.lit(1)).alias("n"))


def patient_weights(spark, d):
    return M.subject_weights(scored(spark, d)).groupBy("subject").agg(F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("weight"))


def sample_sets(spark, d):
    g = grid(spark, d)
    usable = W.point_window(point_events(spark, d).where("var = 'login'"), g, WIDTH, STEP, clock="a")
    s = M.sample_sets(g, usable, ["key", "k"], {"main": F.col("k") <= 11, "early": F.col("k") <= 3})
    return s.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("paired", "main", "early")])


def _bins(spark, d):
    g = grid(spark, d)
    return W.hourly_bins(W.point_window(point_events(spark, d), g, WIDTH, STEP, clock="a"))


def delta_since_last(spark, d):
    b = _bins(spark, d).where(F.col("var").isin(CHANNELS))
    return M.since_last(b, ["key", "k"], 24, 48).select("key", "k", "var", "bin", "delta").groupBy("key", "k", "var").agg(F.sum("delta").alias("total"), F.max("delta").alias("most"), F.min(F.when(F.col("delta") == 0, F.col("bin"))).alias("first_bin"))


def tensors(spark, d):
    return M.tensors(_bins(spark, d).where(F.col("var").isin(CHANNELS)), ["key", "k"], CHANNELS, TENSOR_WIDTH)


def densities(spark, d):
    """(key, k, density): the share of a landmark's cells (channel, bin) that are observed, counted without laying them out as tensors() does."""
    known = F.col("value_median").isNotNull() & F.col("bin").between(0, TENSOR_WIDTH - 1)
    b = _bins(spark, d).where(F.col("var").isin(CHANNELS))
    return b.groupBy("key", "k").agg((F.count(F.when(known, 1)) / (len(CHANNELS) * TENSOR_WIDTH)).alias("density"))


def tensor_rows(spark, d):
    t = tensors(spark, d)
    total = lambda a: F.aggregate(F.flatten(a), F.lit(0.0), lambda s, v: s + v)
    flat = F.flatten(F.transform("m", lambda r: F.transform(r, lambda v: v.cast("int").cast("double"))))
    return t.select("key", "k", F.round(total(F.col("x")), 4).alias("sum_x"), F.aggregate(flat, F.lit(0.0), lambda s, v: s + v).cast("long").alias("n_observed"), total(F.transform("d", lambda r: F.transform(r, lambda v: v.cast("double")))).cast("long").alias("sum_d"))


def seed_ensemble(spark, d):
    s = scored(spark, d)
    both = s.select("subject", "k", "y", "score").unionByName(s.select("subject", "k", "y", F.col("score_b").alias("score")))
    return M.ensemble(both, ["subject", "k"]).select("subject", "k", F.round("score", 9).alias("score"), "n_seeds")


def _packages(spark, d):
    """Per model and set the landmarks that have what the model needs, with the label of the next 24 hours and the bin of its time."""
    g, e = grid(spark, d), point_events(spark, d)
    master = g.withColumn("set_name", F.when(F.col("key") % 5 == 0, "test").when(F.col("key") % 5 == 1, "valid").otherwise("train"))
    usable = W.point_window(e.where("var = 'error'"), g, WIDTH, STEP, clock="a")
    after = O.next_after(g, e, {"next": F.col("var") == "purchase"})
    hit = F.coalesce(F.col("next") <= F.col("t") + WIDTH, F.lit(False)).cast("int")
    labels = after.select("key", "k", hit.alias("y"), O.event_bin(F.coalesce("next", "t"), F.col("t"), hit, 6 * HOUR, 4).alias("bin"))
    return A.packages(master.select("key", "k", "set_name"), {"base": None, "with_errors": usable}, labels)


def packages(spark, d):
    """Written by model and set, and counted by both and label bin."""
    path = S.scratch(spark)
    S.write_table(_packages(spark, d), path, ("model", "set_name"))
    return spark.read.parquet(path).groupBy("model", "set_name", "y", "bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_subjects"))


def _model_rows(spark, d):
    s = M.subject_weights(scored(spark, d))
    s = s.withColumns({"z": logit(F.col("score")), "zb": logit(F.col("score_b")), "label": F.col("y").cast("double"), "valid": hash_fraction(F.col("subject"), F.lit("v")) < 0.3})
    return M.balanced(s, "y", "weight")


def logit_fit(spark, d):
    s = _model_rows(spark, d)
    x = M.score_with(M.logistic(s.where("not valid"), ["z", "zb"], "label", "class_weight", 0.1), s, ["z", "zb"])
    loss = -F.ln(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return x.groupBy("valid", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg(loss), 3).alias("loss"))


def gbt_fit(spark, d):
    s = _model_rows(spark, d)
    return M.score_with(M.boosted(s, ["z", "zb"], "label", "class_weight", "valid"), s, ["z", "zb"]).select("id", "y", "valid", R6("p"))


def platt_fit(spark, d):
    s = _model_rows(spark, d)
    a, b = M.platt(s.where("valid"), "score", "y")
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
    return s.where("not valid").select("id", "y", F.round(p, 6).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (channel_scaler_fit, channel_scaled, static_scaler, median_impute, rare_onehot, onehot_columns, static_matrix, frozen_external, artifact_registry, mad_thresholds, qc_apply, patient_weights, sample_sets, delta_since_last, tensor_rows, seed_ensemble, packages, logit_fit, gbt_fit, platt_fit)
}

_E = "e AS (SELECT event_id, user_id AS key, event_type AS var, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events), tr AS (SELECT * FROM e WHERE key % 3 <> 0)"
_F = "f AS (SELECT var, avg(value) AS mean, stddev_pop(value) + 1e-8 AS sd, count(value) AS n FROM tr WHERE value IS NOT NULL GROUP BY var)"
_P = "p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 8 <> 0 THEN p_size::DOUBLE END AS p_size, p_retailprice FROM part), tr AS (SELECT * FROM p WHERE p_partkey % 4 <> 0), s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) + 1e-8 AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) + 1e-8 AS s2, median(p_size) AS md FROM tr)"
_T = "m AS (SELECT var, median(value) AS md, quantile_cont(value, 0.99) AS p99 FROM tr WHERE value IS NOT NULL GROUP BY var), a AS (SELECT tr.var, median(abs(value - md)) AS mad FROM tr JOIN m ON tr.var = m.var WHERE value IS NOT NULL GROUP BY tr.var)"
TENSOR_BINS = "b AS (SELECT key, k, var, CAST(least(floor((t - e) / 3600000000.0), 23) AS INT) AS bin, median(value) AS v FROM w WHERE var IN ('click', 'view', 'purchase') GROUP BY ALL)"
_C = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 150 = 1 THEN 'RARE' WHEN c_custkey % 20 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal::DOUBLE END AS balance, (c_custkey % 90 + 10)::DOUBLE AS age FROM customer), tr AS (SELECT * FROM c WHERE c_custkey % 4 <> 0),
s AS (SELECT avg(balance) AS m1, stddev_pop(balance) + 1e-8 AS s1, median(balance) AS md, avg(age) AS m2, stddev_pop(age) + 1e-8 AS s2, median(age) AS md2 FROM tr)"""
_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_HOT = ", ".join(f"coalesce(segment = '{x}', false)::INT AS \"segment={x}\"" for x in _LEVELS) + f", (segment IS NULL OR segment NOT IN {_LEVELS})::INT AS \"segment=Unknown\""
_MROWS = f"""w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY subject) AS wt, {LOGIT.format('score')} AS z, {LOGIT.format('score_b')} AS zb, ('0x' || substr(md5(subject || ':v'), 1, 8))::BIGINT / 4294967296.0 < 0.3 AS valid FROM scored),
m AS (SELECT *, wt * sum(wt) OVER () / (2 * sum(wt) OVER (PARTITION BY y)) AS cw FROM w)"""


def _ridge(rounds: int, c: float) -> str:
    """Newton steps of a weighted logistic regression on z and zb: coefficients b0 (free), b1 and b2 (penalised), by Cramer's rule."""
    steps = ["q0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for i in range(rounds):
        sums = f"SELECT b0, b1, b2, sum(r) AS g0, sum(r * z) - b1 / {c} AS g1, sum(r * zb) - b2 / {c} AS g2, sum(h) AS a, sum(h * z) AS b, sum(h * zb) AS c, sum(h * z * z) + 1 / {c} AS d, sum(h * z * zb) AS e, sum(h * zb * zb) + 1 / {c} AS f FROM (SELECT *, cw * (y - p) AS r, cw * p * (1 - p) AS h FROM (SELECT m.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z + b2 * zb))) AS p FROM m, q{i} WHERE NOT valid)) GROUP BY b0, b1, b2"
        det = "(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c))"
        solved = f"b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / {det} AS b0, b1 + (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / {det} AS b1, b2 + (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / {det} AS b2"
        steps.append(f"q{i + 1} AS (SELECT {solved} FROM ({sums}))")
    return ", ".join(steps)


_MODEL = f"{_MROWS}, {_ridge(12, 0.1)}"
ORACLES = {
    "channel_scaler_fit": f"WITH {_E}, {_F} SELECT var, round(mean, 6) AS mean, round(sd, 6) AS sd, n, 'train' AS fitted_on FROM f",
    "channel_scaled": f"WITH {_E}, {_F} SELECT event_id, round(CASE WHEN value IS NOT NULL THEN (value - mean) / sd ELSE 0 END, 6) AS scaled FROM e LEFT JOIN f ON e.var = f.var",
    "static_scaler": f"WITH {_P} SELECT p_partkey, round((p_size - m1) / s1, 6) AS p_size_z, round((p_retailprice - m2) / s2, 6) AS p_retailprice_z FROM p, s",
    "median_impute": f"WITH {_P} SELECT p_partkey, round(coalesce(p_size, md), 6) AS p_size, (p_size IS NULL)::INT AS p_size_missing FROM p, s",
    "rare_onehot": f"WITH {_P}, l AS (SELECT lv FROM (SELECT CASE WHEN p_partkey % 50 = 0 OR p_brand IS NULL THEN 'Unknown' ELSE p_brand END AS lv FROM tr) GROUP BY lv HAVING count(*) >= 0.04 * (SELECT count(*) FROM tr) AND lv <> 'Unknown') SELECT coalesce(lv, 'Unknown') AS level, count(*) AS n FROM p LEFT JOIN l ON p_brand = lv GROUP BY 1",
    "onehot_columns": f"WITH {_C} SELECT c_custkey, {_HOT} FROM c",
    "static_matrix": f"WITH {_C} SELECT c_custkey, round((coalesce(balance, md) - m1) / s1, 6) AS balance_z, round((age - m2) / s2, 6) AS age_z, (balance IS NULL)::INT AS balance_missing, {_HOT} FROM c, s",
    "frozen_external": f"WITH {_C}, x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' WHEN s_suppkey % 3 = 1 THEN 'OTHER' END AS segment, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal::DOUBLE END AS balance FROM supplier) SELECT s_suppkey, round((coalesce(balance, md) - m1) / s1, 6) AS balance_z, round((md2 - m2) / s2, 6) AS age_z, (balance IS NULL)::INT AS balance_missing, 1 AS age_missing, {_HOT} FROM x, s",
    "artifact_registry": f"""WITH {_C}, a AS (SELECT 'columns' AS name, unnest([concat_ws('|', 'balance', CAST(round(round(m1, 3) * 1000000) AS BIGINT), CAST(round(round(md, 3) * 1000000) AS BIGINT), 'train'), concat_ws('|', 'age', CAST(round(round(m2, 3) * 1000000) AS BIGINT), CAST(round(round(md2, 3) * 1000000) AS BIGINT), 'train')]) AS txt FROM s
 UNION ALL SELECT 'levels', concat_ws('|', lv, CAST(round(round(n / sum(n) OVER (), 6) * 1000000) AS BIGINT), CASE WHEN n / sum(n) OVER () >= 0.02 AND lv <> 'Unknown' THEN 'true' ELSE 'false' END, 'train') FROM (SELECT coalesce(segment, 'Unknown') AS lv, count(*) AS n FROM tr GROUP BY 1))
 SELECT name, 'train' AS fitted_on, count(*) AS n_params, CAST(sum(('0x' || substr(md5(txt), 1, 15))::BIGINT) AS VARCHAR) AS content FROM a GROUP BY name""",
    "logit_fit": sql("scored", more=_MODEL, body="SELECT valid, y, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 3) AS loss FROM (SELECT m.*, 1 / (1 + exp(-(b0 + b1 * z + b2 * zb))) AS p FROM m, q12) GROUP BY valid, y"),
    "platt_fit": sql("scored", more=f"{_MROWS}, v AS (SELECT 1 AS one, z AS x, y FROM m WHERE valid), {newton('v', 'one')}", body="SELECT id, y, round(1 / (1 + exp(-(a + b * z))), 6) AS p FROM m, n8 WHERE NOT valid"),
    "mad_thresholds": f"WITH {_E}, {_T} SELECT m.var, round(md, 6) AS median, round(mad, 6) AS mad, CASE WHEN m.var <> 'error' THEN round(md - 3 * mad, 6) END AS low, round(CASE WHEN m.var = 'error' THEN p99 ELSE md + 3 * mad END, 6) AS high FROM m JOIN a ON m.var = a.var",
    "qc_apply": f"WITH {_E}, {_T} SELECT e.var, coalesce(value BETWEEN md - 1.5 * mad AND md + 1.5 * mad, false) AS passed, count(*) AS n FROM e JOIN m ON e.var = m.var JOIN a ON e.var = a.var GROUP BY 1, 2",
    "patient_weights": "SELECT user_id AS subject, 1.0::DOUBLE AS total, round(1.0 / count(*), 6)::DOUBLE AS weight FROM events GROUP BY user_id",
    "sample_sets": sql("ev", "grid", more=STRICT + ", u AS (SELECT DISTINCT key, k FROM w WHERE var = 'login')", body="SELECT g.k, count(*) AS n, count(u.key) AS paired, count(*) FILTER (g.k <= 11) AS main, count(*) FILTER (g.k <= 3) AS early FROM grid g LEFT JOIN u ON g.key = u.key AND g.k = u.k GROUP BY g.k"),
    "delta_since_last": sql(
        "ev", "grid", more=STRICT + ", " + TENSOR_BINS + ", s AS (SELECT DISTINCT key, k, var FROM b), c AS (SELECT s.*, i, (SELECT max(bin) FROM b WHERE b.key = s.key AND b.k = s.k AND b.var = s.var AND bin <= i) AS last_bin FROM s, (SELECT unnest(generate_series(0, 23)) AS i))",
        body="SELECT key, k, var, CAST(sum(least(coalesce(i - last_bin, 48), 48)) AS BIGINT) AS total, max(least(coalesce(i - last_bin, 48), 48)) AS most, min(i) FILTER (i = last_bin) AS first_bin FROM c GROUP BY key, k, var",
    ),
    "tensor_rows": sql(
        "ev", "grid", more=STRICT + ", " + TENSOR_BINS + ", r AS (SELECT DISTINCT key, k FROM b), c AS (SELECT r.*, ch, i, (SELECT max(23 - bin) FROM b WHERE b.key = r.key AND b.k = r.k AND b.var = ch AND 23 - bin <= i) AS last_i FROM r, (SELECT unnest(['click', 'view', 'purchase']) AS ch), (SELECT unnest(generate_series(0, 23)) AS i)), x AS (SELECT key, k, sum(v) AS sx, count(*) AS n FROM b GROUP BY key, k)",
        body="SELECT c.key, c.k, round(any_value(sx), 4) AS sum_x, any_value(n) AS n_observed, CAST(sum(least(coalesce(i - last_i, 48), 48)) AS BIGINT) AS sum_d FROM c JOIN x ON c.key = x.key AND c.k = x.k GROUP BY c.key, c.k",
    ),
    "seed_ensemble": sql("scored", body="SELECT subject, k, round(avg(s), 9) AS score, count(*) AS n_seeds FROM (SELECT subject, k, score AS s FROM scored UNION ALL SELECT subject, k, score_b FROM scored) GROUP BY subject, k"),
    "packages": sql(
        "ev", "grid", more=STRICT + """, u AS (SELECT DISTINCT key, k FROM w WHERE var = 'error'), g AS (SELECT key, k, t, CASE key % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS set_name, (SELECT min(e) FROM ev WHERE ev.key = grid.key AND var = 'purchase' AND e > t) AS nxt FROM grid),
l AS (SELECT *, coalesce(nxt <= t + 86400000000, false)::INT AS y FROM g), b AS (SELECT *, CASE WHEN y = 0 THEN 4 ELSE CAST(least(greatest(ceil((nxt - t) / 21600000000.0), 1), 4) AS INT) END AS bin FROM l)""",
        body="SELECT 'base' AS model, set_name, y, bin, count(*) AS n, count(DISTINCT key) AS n_subjects FROM b GROUP BY set_name, y, bin UNION ALL SELECT 'with_errors', set_name, y, bin, count(*), count(DISTINCT b.key) FROM b JOIN u ON b.key = u.key AND b.k = u.k GROUP BY set_name, y, bin",
    ),
}
