"""Queries over signal arrays: a vector is a lead, eight vectors are a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import signals as S
from .fixtures import table

R = lambda c, n=6: F.round(c, n).alias(c)
LEADS = [f"L{i}" for i in range(8)]


def _signals(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).alias("record"), F.concat(F.lit("L"), (F.col("vec_id") % 8).cast("string")).alias("lead"), S.doubles(F.col("embedding")).alias("signal"), "vec_id", "label")


def lead_stats(spark, d):
    s = _signals(spark, d).withColumn("mean", S.mean_of(F.col("signal")))
    return s.select("vec_id", R("mean"), F.round(S.sd_of(F.col("signal"), F.col("mean")), 6).alias("sd"))


def record_zscore(spark, d):
    z = S.zscored(_signals(spark, d))
    return z.select("vec_id", F.round(F.get("z", 0), 5).alias("first"), F.round(F.array_max("z"), 5).alias("highest"))


def global_norm(spark, d):
    return S.global_norm(_signals(spark, d).where("record % 3 <> 0")).select("lead", R("mean"), R("sd"), "n")


def snr_saturation(spark, d):
    x = S.snr_saturation(_signals(spark, d).withColumn("signal", F.when(F.col("vec_id") % 7 == 3, F.slice("signal", 1, 40)).otherwise(F.col("signal"))), "L1", 0.3, 50)
    return x.select("record", R("snr_db", 5), R("saturated"), R("extreme"))


def flatline_qc(spark, d):
    s = _signals(spark, d).withColumn("signal", F.when(F.col("vec_id") % 5 == 0, F.array_repeat(F.lit(0.0), 64)).when(F.col("vec_id") % 7 == 0, F.slice("signal", 1, 40)).otherwise(F.col("signal")))
    return S.structural(s, 8, 50)


def lead_order(spark, d):
    s = _signals(spark, d).withColumn("signal", F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 0, F.slice("signal", 1, 15)).otherwise(F.col("signal")))
    r = S.reorder(s, LEADS[::-1], 16)
    total = F.aggregate(F.flatten("signals"), F.lit(0.0), lambda a, v: a + v)
    return r.select("record", F.size("signals").alias("n_leads"), F.size(F.flatten("signals")).alias("n_values"), F.size(F.filter("lead_mask", lambda m: m)).alias("n_present"), F.round(total, 5).alias("total"))


def measurement_derivations(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.round(F.get("embedding", i).cast("double") * 1000, 3).alias(n) for i, n in enumerate(("rr", "qrs_start", "qrs_end", "t_end", "p_start"))])
    return S.measurements(e).select("vec_id", R("rate", 4), R("qrs", 4), R("pr", 4), R("qt", 4), R("qtc", 3))


def masked_by_availability(spark, d):
    s = _signals(spark, d).withColumn("m", S.mean_of(F.col("signal")))
    x = A.masked(s.withColumn("feature", F.round("m", 6)), ["feature"], F.when(F.col("vec_id") % 13 != 0, F.col("label") < 5))
    return x.select("vec_id", "feature", "available")


def band_power(spark, d):
    return S.band_power(_signals(spark, d), 64.0, (10.0, 12.0), (0.5, 32.0)).select("record", "lead", R("ratio"))


def spikes(spark, d):
    return S.spikes(_signals(spark, d), 2.0, 0.2)


def median_drift(spark, d):
    return S.median_drift(_signals(spark, d), 9).select("record", "lead", R("drift"))


def lead_corr(spark, d):
    return S.lead_correlation(_signals(spark, d), 2).select("record", R("median_r"))


QUERIES = {f.__name__: f for f in (lead_stats, record_zscore, global_norm, snr_saturation, flatline_qc, lead_order, measurement_derivations, masked_by_availability, band_power, spikes, median_drift, lead_corr)}

_V = "v AS (SELECT vec_id, vec_id // 8 AS record, 'L' || vec_id % 8 AS lead, label, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)"
_U = "u AS (SELECT vec_id, record, lead, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM v)"
ORACLES = {
    "lead_stats": f"WITH {_V}, {_U} SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM u GROUP BY vec_id",
    "record_zscore": f"WITH {_V}, {_U}, g AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY vec_id) SELECT u.vec_id, round(max(x) FILTER (i = 1) - any_value(m), 12) * 0 + round((max(x) FILTER (i = 1) - any_value(m)) / (any_value(sd) + 1e-8), 5) AS first, round((max(x) - any_value(m)) / (any_value(sd) + 1e-8), 5) AS highest FROM u JOIN g ON u.vec_id = g.vec_id GROUP BY u.vec_id",
    "global_norm": f"WITH {_V}, {_U} SELECT lead, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, count(*) AS n FROM u WHERE record % 3 <> 0 GROUP BY lead",
    "snr_saturation": f"WITH {_V}, {_U}, c AS (SELECT * FROM u WHERE vec_id % 7 <> 3 OR i <= 40), w AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS dx, max(x) OVER (PARTITION BY vec_id) AS hi, min(x) OVER (PARTITION BY vec_id) AS lo FROM c), g AS (SELECT record, lead, vec_id, CASE WHEN count(*) >= 50 THEN var_pop(x) END AS v, CASE WHEN count(*) >= 50 THEN var_pop(dx) / 2 END AS w, avg((x = hi OR x = lo)::INT) AS s, avg((abs(x) > 0.3)::INT) AS e FROM w GROUP BY ALL) SELECT record, round(CASE WHEN count(v) > 0 THEN 10 * log10(greatest(avg(v), 1e-12) / greatest(avg(w), 1e-12)) END, 5) AS snr_db, round(max(s) FILTER (lead = 'L1'), 6) AS saturated, round(max(e) FILTER (lead = 'L1'), 6) AS extreme FROM g GROUP BY record",
    "flatline_qc": f"WITH {_V}, f AS (SELECT record, vec_id % 5 = 0 OR list_max(s) = list_min(s) AS flat, CASE WHEN vec_id % 5 = 0 THEN 64 WHEN vec_id % 7 = 0 THEN 40 ELSE len(s) END AS n FROM v) SELECT record, count(*) AS n_leads, min(n) AS length, count(*) FILTER (flat) AS n_flat, count(*) >= 8 AND min(n) >= 50 AND count(*) FILTER (flat) < count(*) AS passed FROM f GROUP BY record",
    "lead_order": f"WITH {_V}, {_U} SELECT record, 8 AS n_leads, 128 AS n_values, count(DISTINCT lead) FILTER (vec_id % 11 <> 0 AND vec_id % 5 <> 0) AS n_present, round(coalesce(sum(x) FILTER (i <= 16 AND vec_id % 11 <> 0 AND vec_id % 5 <> 0), 0), 5) AS total FROM u GROUP BY record",
    "measurement_derivations": f"WITH {_V}, p AS (SELECT vec_id, round(s[1] * 1000, 3) AS rr, round(s[2] * 1000, 3) AS b, round(s[3] * 1000, 3) AS c, round(s[4] * 1000, 3) AS e, round(s[5] * 1000, 3) AS a FROM v), q AS (SELECT vec_id, CASE WHEN rr > 0 THEN rr END AS rr, CASE WHEN c - b > 0 THEN c - b END AS qrs, CASE WHEN b - a > 0 THEN b - a END AS pr, CASE WHEN e - b > 0 THEN e - b END AS qt FROM p) SELECT vec_id, round(60000.0::DOUBLE / rr, 4) AS rate, round(qrs, 4) AS qrs, round(pr, 4) AS pr, round(qt, 4) AS qt, round(qt / sqrt(rr / 1000.0::DOUBLE), 3) AS qtc FROM q",
    "masked_by_availability": f"WITH {_V} SELECT vec_id, CASE WHEN label < 5 AND vec_id % 13 <> 0 THEN round(list_avg(s), 6) END AS feature, (label < 5 AND vec_id % 13 <> 0)::INT AS available FROM v",
    "band_power": f"WITH {_V}, {_U}, z AS (SELECT vec_id, record, lead, i, x - avg(x) OVER (PARTITION BY vec_id) AS x, count(*) OVER (PARTITION BY vec_id) AS n FROM u), f AS (SELECT vec_id, record, lead, q, pow(sum(x * cos(2 * pi() * q * (i - 1) / n)), 2) + pow(sum(x * sin(2 * pi() * q * (i - 1) / n)), 2) AS p FROM z, (SELECT unnest(generate_series(0, 32)) AS q) GROUP BY ALL) SELECT record, lead, round(sum(p) FILTER (q BETWEEN 10 AND 12) / sum(p) FILTER (q BETWEEN 0.5 AND 32), 6) AS ratio FROM f GROUP BY record, lead, vec_id",
    "spikes": f"WITH {_V}, {_U}, d AS (SELECT record, vec_id, abs(x - 2 * lag(x) OVER w + lag(x, 2) OVER w) AS d FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i)), m AS (SELECT *, median(d) OVER (PARTITION BY vec_id) AS m FROM d WHERE d IS NOT NULL), k AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY vec_id) AS mad FROM m) SELECT record, count(*) FILTER (d > greatest(m + 2 * mad, 0.2)) AS n_spikes, count(*) FILTER (d > greatest(m + 2 * mad, 0.2)) >= 3 AS spiky FROM k GROUP BY record",
    "median_drift": f"WITH {_V}, {_U}, o AS (SELECT vec_id, record, lead, i, unnest(generate_series(i - 4, i + 4)) AS j, count(*) OVER (PARTITION BY vec_id) AS n FROM u), c AS (SELECT vec_id, record, lead, i, least(greatest(j, 1), n) AS j FROM o), m AS (SELECT c.vec_id, c.record, c.lead, c.i, median(u.x) AS m FROM c JOIN u ON c.vec_id = u.vec_id AND c.j = u.i GROUP BY ALL) SELECT record, lead, round(max(m) - min(m), 6) AS drift FROM m GROUP BY record, lead, vec_id",
    "lead_corr": f"WITH {_V}, {_U}, p AS (SELECT * FROM u WHERE i % 2 = 1), r AS (SELECT a.record, a.lead AS la, b.lead AS lb, abs(corr(a.x, b.x)) AS r FROM p a JOIN p b ON a.record = b.record AND a.i = b.i AND a.lead < b.lead GROUP BY ALL), k AS (SELECT record, median(r) AS r FROM r GROUP BY record) SELECT v.record, round(coalesce(any_value(k.r), 0), 6) AS median_r FROM v LEFT JOIN k ON v.record = k.record GROUP BY v.record",
}
