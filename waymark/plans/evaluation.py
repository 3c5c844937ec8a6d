"""Queries that evaluate scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import evaluate as E
from ..operators import fitting as M
from ..sources import stored
from .fitting import TENSOR_BINS, densities
from .fixtures import LOGIT, STRICT, newton, scored, sql

R = lambda c, n=6: F.round(c, n).alias(c)
R6 = R
REPLICATES = 2000
GRID = [round(0.02 * i, 2) for i in range(1, 40)]


def auroc_by_k(spark, d):
    return E.auroc(scored(spark, d), ["k"]).select("k", "n", "n_pos", R("auroc"))


def iauroc(spark, d):
    return E.integrated(E.auroc(scored(spark, d), ["k"]), [], 12).select(R("iauroc"), R("partial"), "n_estimable")


def brier(spark, d):
    return E.brier(scored(spark, d), ["k"]).select("k", R("brier"))


def cal_in_large(spark, d):
    return E.brier(scored(spark, d), ["avail"]).select("avail", R("mean_score"), R("rate"), R("in_the_large"))


def decile_curve(spark, d):
    return E.calibration_curve(scored(spark, d)).select("bin", "n", R("predicted"), R("observed"))


def net_benefit_curve(spark, d):
    return E.net_benefit(scored(spark, d), GRID, []).select("pt", "n", "tp", "fp", R("nb"), R("nb_all"))


def segment_net_benefit(spark, d):
    s = scored(spark, d).withColumn("segment", E.segments(F.col("k") * 2))
    return E.net_benefit(s, [0.2, 0.5, 0.8], ["segment"]).select("segment", "pt", "n", "tp", "fp", R("nb"))


def fixed_dca(spark, d):
    x = E.fixed_thresholds(scored(spark, d), [0.1, 0.3, 0.5, 0.7], "score", "score_b")
    return x.select("pt", *[R(c) for c in ("tp_a", "fp_a", "tp_b", "fp_b", "delta_nb")])


def patient_first_dca(spark, d):
    return E.net_benefit(E.one_per_subject(scored(spark, d), "first"), [0.2, 0.5], []).select("pt", "n", "tp", "fp", R("nb"))


def patient_max_dca(spark, d):
    return E.net_benefit(E.one_per_subject(scored(spark, d), "highest"), [0.5, 0.8, 0.9], []).select("pt", "n", "tp", "fp", R("nb"))


def subgroup_auroc(spark, d):
    s = scored(spark, d).withColumn("level", F.when(F.col("subject") % 10 < 3, "young").when(F.col("subject") % 10 < 9, "old").otherwise("unknown"))
    a, b = E.auroc(s, ["level"]), E.auroc(s, ["level"], "score_b").select("level", F.col("auroc").alias("auroc_b"))
    j = a.join(b, "level")
    return j.select("level", "n", "n_pos", *[F.when(F.col("n") >= 100, F.round(c, 6)).alias(c) for c in ("auroc", "auroc_b")])


def routed_score(spark, d):
    s = scored(spark, d).withColumn("routed", E.routed(F.col("avail"), F.col("score_b"), F.col("score")))
    return E.auroc(s, ["k"], "routed").select("k", R("auroc"))


def _grouped(spark, d):
    return scored(spark, d).withColumn("group", F.col("subject") % 7)


def group_gate(spark, d):
    return E.gated_iauroc(_grouped(spark, d), "group", 60, 20, 12).select("group", "n", "n_pos", R("iauroc"))


def group_spread(spark, d):
    s = _grouped(spark, d)
    x = E.spread(E.gated_iauroc(s, "group", 100, 20, 12), s, "group", 0.9)
    return x.select("n_groups", *[R(c) for c in ("q1", "median", "q3", "share_below", "largest_share")])


def density_tertiles(spark, d):
    """Metrics by thirds of the share of a landmark's cells (channel, bin) that are observed."""
    cells = densities(spark, d).withColumnRenamed("key", "subject")
    # Limits, draws, sums and points read these rows again and again.
    s = E.with_tertile(stored(scored(spark, d).join(cells, ["subject", "k"]).select("subject", "k", "y", "score", "density")), "density")
    boot = B.iaurocs(s, ["tertile"], B.draws(s, REPLICATES, mode="membership", by=("tertile",)), REPLICATES, 12, own_draws=("tertile",))
    sizes = s.groupBy("tertile").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"))
    point = E.integrated(E.auroc(s, ["tertile", "k"]), ["tertile"], 12).select("tertile", "iauroc")
    around = E.intervals(boot, ["tertile"], "iauroc")
    return sizes.join(point, "tertile").join(around, "tertile", "left").select("tertile", "n", "n_pos", R("iauroc"), R("brier"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), R("mean"), R("low"), R("high"))


def _times(spark, d):
    return scored(spark, d).withColumns({"bin": (F.col("id") % 14 + 1).cast("int"), "cause": (F.col("id") % 5 % 4).cast("int"), "third": F.col("subject") % 3})


def km_incidence(spark, d):
    return E.incidence(_times(spark, d), 1, ["third"]).select("third", "bin", "at_risk", "d", R("incidence"))


def km_calibration(spark, d):
    c = E.km_calibration(_times(spark, d).withColumnRenamed("bin", "time_bin"), 1, 7, "score", 5)
    return c.select("group", "n", R("predicted"), R("observed"))


def td_cindex(spark, d):
    t = _times(spark, d)
    x, h = E.concordance(t, 1), E.concordance(t, 1, same_bin=True, tie=0.5)
    return x.select(R("concordance"), "pairs").crossJoin(h.select(F.round("concordance", 6).alias("with_ties_and_censored"), F.col("pairs").alias("pairs_2")))


def smd_table(spark, d):
    return E.standardised_differences(scored(spark, d), F.col("avail"), ["score", "score_b", "y", "k"]).select("column", R("mean_1"), R("mean_0"), R("smd"))


def _boot(spark, d, scores, mode="multinomial"):
    s = scored(spark, d)
    x = B.aurocs(s, [], B.draws(s, REPLICATES, mode=mode), REPLICATES, score=scores).withColumnRenamed("b", "replicate")
    return B.side_by_side(x, ["replicate"], "stat", list(scores), "auroc")


def boot_ci(spark, d):
    i = E.interval(_boot(spark, d, {"a": "score", "b": "score_b"}), {"a": F.col("a"), "b": F.col("b"), "difference": F.col("b") - F.col("a")})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


def boot_membership_ci(spark, d):
    i = E.interval(_boot(spark, d, {"a": "score"}, "membership"), {"a": F.col("a")})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


def _joint(rows, by, scores, drawn, own_draws=()):
    """(by, replicate, one column a score): iAUROC of all scores and groups under the same draws."""
    x = B.iaurocs(rows, by, drawn, REPLICATES, 12, score=scores, own_draws=own_draws).withColumnRenamed("b", "replicate")
    return B.side_by_side(x, [*by, "replicate"], "stat", list(scores), "iauroc")


def interaction(spark, d):
    """The gain in iAUROC in two groups of rows and its difference, under one bootstrap of all subjects."""
    s = scored(spark, d)
    x = _joint(s, ["avail"], {"a": "score", "b": "score_b"}, B.draws(s, REPLICATES, mode="membership"))
    g = x.groupBy("replicate").agg(*[F.max(F.when(F.col("avail") == v, F.col("b") - F.col("a"))).alias(n) for n, v in (("on", True), ("off", False))])
    i = E.interval(g, {"on": F.col("on"), "off": F.col("off"), "interaction": F.col("on") - F.col("off")})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


def control_contrast(spark, d):
    """Three scores against each other by iAUROC, and two of them where the second is available, under one bootstrap; a replicate counts only if all three can be estimated."""
    s = scored(spark, d).withColumn("control", F.round((F.col("score") + F.col("score_b")) / 2, 6))
    scores, drawn = {"a": "score", "b": "score_b", "control": "control"}, B.draws(s, REPLICATES, mode="membership")
    grid = s.withColumn("grid", F.explode(F.when(F.col("avail"), F.array(F.lit("all"), F.lit("available"))).otherwise(F.array(F.lit("all")))))
    x = _joint(grid, ["grid"], scores, drawn)
    g = x.groupBy("replicate").agg(*[F.max(F.when(F.col("grid") == n, F.col(c))).alias(f"{c}_{n}") for n in ("all", "available") for c in scores])
    a, b, c = (F.col(f"{x}_all") for x in scores)
    whole = (a + b + c).isNotNull()
    i = E.interval(g, {"b-a": F.when(whole, b - a), "c-a": F.when(whole, c - a), "b-c": F.when(whole, b - c), "b-c available": F.when(whole, F.col("b_available") - F.col("control_available"))})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


def subgroup_audit(spark, d):
    """Of each level of each dimension rows, subjects, events, the iAUROC of two scores, and their difference with an interval from the level's own subjects; levels of under 100 rows are named with their number only."""
    age = F.when(F.col("subject") % 10 < 3, "young").when(F.col("subject") % 10 < 9, "old").otherwise("unknown")
    sex = F.when(F.col("subject") % 2 == 0, "F").otherwise("M")
    s = E.by_dimension(scored(spark, d), {"age": age, "sex": sex})
    by = ["dim", "level"]
    sizes = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects"), F.sum("y").alias("events"))
    point = B.side_by_side(E.integrated(E.auroc(B.stacked(s, {"a": "score", "b": "score_b"}), [*by, "stat", "k"]), [*by, "stat"], 12), by, "stat", ["a", "b"], "iauroc")
    boot = _joint(s, by, {"a": "score", "b": "score_b"}, B.draws(s, REPLICATES, mode="membership", by=tuple(by)), tuple(by)).withColumn("delta", F.col("b") - F.col("a"))
    j = sizes.join(point, by, "left").join(E.intervals(boot, by, "delta"), by, "left")
    shown, estimable = F.col("n") >= 100, F.col("a").isNotNull() & F.col("b").isNotNull()
    r = lambda c, ok: F.when(ok, F.round(c, 6))
    return j.select(
        *by, "n", *[F.when(shown, F.col(c)).alias(c) for c in ("n_subjects", "events")], r(F.col("a"), shown).alias("iauroc_a"), r(F.col("b"), shown).alias("iauroc_b"),
        r(F.col("b") - F.col("a"), shown).alias("delta"), *[r(F.col(c), shown & estimable).alias(c) for c in ("low", "high")],
    )


def patient_dca(spark, d):
    """One row a patient (the first landmark, or that of the highest second score): AUROC of both scores, and their net benefits with the interval of the difference per 1000 patients."""
    parts = []
    for mode in ("first", "highest"):
        s = E.one_per_subject(scored(spark, d), mode, "score_b")
        pts = [0.2, 0.5, 0.8]
        nb = lambda c, n: E.net_benefit(s, pts, [], c).select("pt", F.col("nb").alias(n))  # noqa: E731, B023
        boot = B.net_benefits(s, ["score", "score_b"], pts, B.draws(s, REPLICATES), REPLICATES).withColumn("d", (F.col("score_b") - F.col("score")) * 1000)
        auc = E.auroc(s, []).select(F.col("n").alias("n_patients"), F.col("n_pos").alias("events"), F.col("auroc").alias("auc_a")).crossJoin(E.auroc(s, [], "score_b").select(F.col("auroc").alias("auc_b")))
        j = nb("score", "nb_a").join(nb("score_b", "nb_b"), "pt").join(E.intervals(boot, ["pt"], "d"), "pt").crossJoin(auc)
        parts.append(j.select(F.lit(mode).alias("mode"), "pt", "n_patients", "events", *[R(c) for c in ("auc_a", "auc_b", "nb_a", "nb_b")], F.round((F.col("nb_b") - F.col("nb_a")) * 1000, 6).alias("delta"), *[R(c) for c in ("low", "middle", "high")]))
    return parts[0].unionByName(parts[1])


def calibrated_brier(spark, d):
    """Brier before and after a recalibration fitted on a third of the subjects."""
    s = scored(spark, d)
    a, b = M.platt(s.where("subject % 3 = 0"), "score", "y")
    from ..functions import logit, sigmoid

    t = s.where("subject % 3 <> 0").withColumn("p", sigmoid(F.lit(a) + F.lit(b) * logit(F.col("score"))))
    return t.agg(F.round(F.avg((F.col("score") - F.col("y")) ** 2), 6).alias("before"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("after"))


def calibration_slope(spark, d):
    return E.calibration_line(scored(spark, d), ["avail"]).select("avail", R("slope"), R("intercept"))


def km_slope(spark, d):
    """The line through the calibration curve by incidence, at two horizons."""
    t = _times(spark, d).withColumnRenamed("bin", "time_bin")
    at = lambda h: E.slope(E.km_calibration(t, 1, h, "score", 5)).select(F.lit(h).alias("horizon"), R("slope", 4), R("intercept", 4))
    return at(4).unionByName(at(7))


def km_in_the_large(spark, d):
    """By segments of landmarks and for all, at two horizons: the mean prediction, the incidence of the cause by the horizon, and their difference with an interval."""
    k = F.col("k") * 2
    s = E.by_dimension(_times(spark, d), {"all": F.lit("all"), "segment": E.segments(k)})
    by, at, horizons = ["level"], ["level", "horizon"], [4, 7]
    seen = E.incidence(s, 1, by).select("level", "bin", "incidence", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).where("bin <= horizon").groupBy(*at).agg(F.max("incidence").alias("observed"))
    mean = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("predicted"))
    boot = B.incidences(s, by, B.draws(s, REPLICATES, mode="membership"), REPLICATES, 1, horizons, "score")
    around = E.intervals(boot.withColumn("gap", F.col("predicted") - F.col("observed")), at, "gap")
    j = mean.join(around, by).join(seen, at, "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return j.select("level", "horizon", "n", R("predicted"), R("observed"), F.round(F.col("predicted") - F.col("observed"), 6).alias("in_the_large"), "n_valid", R("mean"), R("low"), R("high"))


def boot_iauroc(spark, d):
    s = scored(spark, d)
    i = E.interval(_joint(s, [], {"a": "score", "b": "score_b"}, B.draws(s, REPLICATES)), {"a": F.col("a"), "difference": F.col("b") - F.col("a")})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


def boot_net_benefit(spark, d):
    """Intervals of the difference in net benefit, over each subject's row of highest score."""
    s = E.one_per_subject(scored(spark, d), "highest")
    b = B.net_benefits(s, ["score", "score_b"], [0.2, 0.5], B.draws(s, REPLICATES), REPLICATES)
    i = E.interval(b.groupBy("b").pivot("pt", [0.2, 0.5]).agg(F.first(F.col("score_b") - F.col("score"))), {"at_20": F.col("`0.2`"), "at_50": F.col("`0.5`")})
    return i.select("stat", "n_valid", R("low"), R("middle"), R("high"))


QUERIES = {
    f.__name__: f
    for f in (
        auroc_by_k, iauroc, brier, cal_in_large, decile_curve, net_benefit_curve, segment_net_benefit, fixed_dca, patient_first_dca, patient_max_dca, subgroup_auroc, routed_score, group_gate, group_spread,
        density_tertiles, km_incidence, km_calibration, td_cindex, smd_table, boot_ci, boot_membership_ci, interaction, control_contrast, calibrated_brier, calibration_slope, km_slope, boot_iauroc, boot_net_benefit,
        subgroup_audit, patient_dca, km_in_the_large,
    )
}


def _auc(by: str, source: str, score: str = "score", w: str = "1") -> str:
    """AUROC by mid-ranks, over the rows of source."""
    p = f"PARTITION BY {by} " if by else ""
    c, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {c}CAST(sum(p + n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (coalesce(lower_, 0) + n / 2.0)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) END AS auroc FROM
 (SELECT *, sum(n) OVER ({p}ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_ FROM (SELECT {c}{score}, sum({w} * y)::BIGINT AS p, sum({w} * (1 - y))::BIGINT AS n FROM {source} GROUP BY {c}{score})) {g}"""


def _nb(source: str, grid: str, by: str = "", score: str = "score") -> str:
    c = f"{by}, " if by else ""
    return f"""SELECT {c}pt, n, tp, fp, tp / n - fp / n * (pt / (1 - pt)) AS nb, n_pos / n - (1 - n_pos / n) * (pt / (1 - pt)) AS nb_all FROM
 (SELECT {c}pt, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, count(*) FILTER ({score} >= pt AND y = 1) AS tp, count(*) FILTER ({score} >= pt AND y = 0) AS fp FROM {source}, (SELECT unnest({grid})::DOUBLE AS pt) GROUP BY {c}pt)"""


def draw(by: str = "", source: str = "scored", weight: str = "count(*)") -> str:
    """dw (by, subject, b, wt): the draws of bootstrap.draws; a weight of 1 is its membership."""
    c, part, using = (f"{by}, ", f"PARTITION BY {by} ", f"{by}, rk") if by else ("", "", "rk")
    return f"""r AS (SELECT {c}subject, row_number() OVER ({part}ORDER BY md5(CAST(subject AS VARCHAR)), subject) - 1 AS rk, count(*) OVER ({part}) AS sz FROM (SELECT DISTINCT {c}subject FROM {source})),
dr AS (SELECT {c}b, (('0x' || substr(md5(rk || ':' || b), 1, 8))::BIGINT * sz) >> 32 AS rk, {weight} AS wt FROM r, (SELECT unnest(generate_series(0, {REPLICATES - 1})) AS b) GROUP BY ALL), dw AS (SELECT * FROM dr JOIN r USING ({using}))"""


def _ia(by: str, source: str, score: str, w: str = "wt") -> str:
    """iAUROC (v) over 12 landmarks of each group."""
    return f"SELECT {by}, CASE WHEN count(auroc) = 12 THEN avg(auroc) END AS v FROM ({_auc(by + ', k', source, score, w)}) GROUP BY {by}"


_DRAW, _MEMBER = draw(), draw(weight="1")
_JOINED = "j AS (SELECT s.*, b, wt FROM scored s JOIN dw USING (subject))"
_Q = "SELECT stat, count(*) AS n_valid, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS middle, round(quantile_cont(v, 0.975), 6) AS high FROM ({}) WHERE v IS NOT NULL GROUP BY stat"
_EDGES = "ed AS (SELECT quantile_cont(score, {q}) AS q FROM scored)"
_X = "x AS (SELECT *, id % 14 + 1 AS bin, id % 5 % 4 AS cause, subject % 3 AS third FROM scored)"


def _km(by: str, source: str) -> str:
    return f"""SELECT {by}, bin, at_risk, d, 1 - CASE WHEN max((d = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS incidence FROM
 (SELECT *, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM (SELECT {by}, bin, count(*) AS n, count(*) FILTER (cause = 1) AS d FROM {source} GROUP BY {by}, bin))
 WINDOW w AS (PARTITION BY {by} ORDER BY bin ROWS UNBOUNDED PRECEDING)"""


def _one(order: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {order}) AS rn FROM scored) WHERE rn = 1"


def _smd(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", round(avg({c}) FILTER (avail), 6) AS mean_1, round(avg({c}) FILTER (NOT avail), 6) AS mean_0, round((avg({c}) FILTER (avail) - avg({c}) FILTER (NOT avail)) / sqrt((var_samp({c}) FILTER (avail) + var_samp({c}) FILTER (NOT avail)) / 2), 6) AS smd FROM scored"


_KMC = "k{h} AS (SELECT y.grp, avg(score) AS predicted, coalesce(any_value(c.observed), 0) AS observed FROM y JOIN (SELECT grp, max(incidence) FILTER (bin <= {h}) AS observed FROM ({km}) GROUP BY grp) c ON y.grp = c.grp GROUP BY y.grp)"
ORACLES = {
    "calibration_slope": sql("scored", more=f"z AS (SELECT avail, {LOGIT.format('score')} AS x, y FROM scored), {newton('z', 'avail')}", body="SELECT avail, round(b, 6) AS slope, round(a, 6) AS intercept FROM n8"),
    "calibrated_brier": sql("scored", more=f"z AS (SELECT 1 AS one, {LOGIT.format('score')} AS x, y FROM scored WHERE subject % 3 = 0), {newton('z', 'one')}", body=f"SELECT round(avg((score - y) * (score - y)), 6) AS before, round(avg(pow(1 / (1 + exp(-(a + b * {LOGIT.format('score')}))) - y, 2)), 6) AS after FROM scored, n8 WHERE subject % 3 <> 0"),
    "km_slope": sql(
        "scored", more=f"{_X}, {_EDGES.format(q='[0.2, 0.4, 0.6, 0.8]')}, y AS (SELECT x.*, CAST(len(list_filter(q, lambda e: e <= score)) + 1 AS INT) AS grp FROM x, ed), {_KMC.format(h=4, km=_km('grp', 'y'))}, {_KMC.format(h=7, km=_km('grp', 'y'))}",
        body="SELECT 4 AS horizon, round(regr_slope(observed, predicted), 4) AS slope, round(regr_intercept(observed, predicted), 4) AS intercept FROM k4 UNION ALL SELECT 7, round(regr_slope(observed, predicted), 4), round(regr_intercept(observed, predicted), 4) FROM k7",
    ),
    "auroc_by_k": sql("scored", body=f"SELECT k, n, n_pos, round(auroc, 6) AS auroc FROM ({_auc('k', 'scored')})"),
    "iauroc": sql("scored", body=f"SELECT round(CASE WHEN count(auroc) = 12 THEN avg(auroc) END, 6) AS iauroc, round(avg(auroc), 6) AS partial, count(auroc) AS n_estimable FROM ({_auc('k', 'scored')})"),
    "brier": sql("scored", body="SELECT k, round(avg((score - y) * (score - y)), 6) AS brier FROM scored GROUP BY k"),
    "cal_in_large": sql("scored", body="SELECT avail, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate, round(avg(score) - avg(y), 6) AS in_the_large FROM scored GROUP BY avail"),
    "decile_curve": sql("scored", more=_EDGES.format(q="[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"), body="SELECT CAST(len(list_filter(q, lambda e: e <= score)) + 1 AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(y), 6) AS observed FROM scored, ed GROUP BY 1"),
    "net_benefit_curve": sql("scored", body=f"SELECT pt, n, tp, fp, round(nb, 6) AS nb, round(nb_all, 6) AS nb_all FROM ({_nb('scored', GRID)})"),
    "segment_net_benefit": sql("scored", more="s AS (SELECT *, CASE WHEN k * 2 <= 3 THEN '0-3' WHEN k * 2 <= 11 THEN '4-11' ELSE '12+' END AS segment FROM scored)", body=f"SELECT segment, pt, n, tp, fp, round(nb, 6) AS nb FROM ({_nb('s', [0.2, 0.5, 0.8], 'segment')})"),
    "fixed_dca": sql("scored", more=f"a AS ({_nb('scored', [0.1, 0.3, 0.5, 0.7])}), z AS ({_nb('scored', [0.1, 0.3, 0.5, 0.7], '', 'score_b')})", body="SELECT a.pt, round(1000 * a.tp / a.n, 6) AS tp_a, round(1000 * a.fp / a.n, 6) AS fp_a, round(1000 * z.tp / z.n, 6) AS tp_b, round(1000 * z.fp / z.n, 6) AS fp_b, round((z.nb - a.nb) * 1000, 6) AS delta_nb FROM a JOIN z ON a.pt = z.pt"),
    "patient_first_dca": sql("scored", more=f"o AS ({_one('k, id')})", body=f"SELECT pt, n, tp, fp, round(nb, 6) AS nb FROM ({_nb('o', [0.2, 0.5])})"),
    "patient_max_dca": sql("scored", more=f"o AS ({_one('score DESC, id')})", body=f"SELECT pt, n, tp, fp, round(nb, 6) AS nb FROM ({_nb('o', [0.5, 0.8, 0.9])})"),
    "subgroup_auroc": sql("scored", more="s AS (SELECT *, CASE WHEN subject % 10 < 3 THEN 'young' WHEN subject % 10 < 9 THEN 'old' ELSE 'unknown' END AS level FROM scored)", body=f"SELECT a.level, a.n, a.n_pos, CASE WHEN a.n >= 100 THEN round(a.auroc, 6) END AS auroc, CASE WHEN a.n >= 100 THEN round(b.auroc, 6) END AS auroc_b FROM ({_auc('level', 's')}) a JOIN ({_auc('level', 's', 'score_b')}) b ON a.level = b.level"),
    "routed_score": sql("scored", more="s AS (SELECT *, CASE WHEN avail THEN score_b ELSE score END AS routed FROM scored)", body=f"SELECT k, round(auroc, 6) AS auroc FROM ({_auc('k', 's', 'routed')})"),
    "km_incidence": sql("scored", more=_X, body=f"SELECT third, bin, at_risk, d, round(incidence, 6) AS incidence FROM ({_km('third', 'x')})"),
    "km_calibration": sql(
        "scored", more=f"{_X}, {_EDGES.format(q='[0.2, 0.4, 0.6, 0.8]')}, y AS (SELECT x.*, CAST(len(list_filter(q, lambda e: e <= score)) + 1 AS INT) AS grp FROM x, ed), c AS (SELECT grp, max(incidence) FILTER (bin <= 7) AS observed FROM ({_km('grp', 'y')}) GROUP BY grp)",
        body="SELECT y.grp AS \"group\", count(*) AS n, round(avg(score), 6) AS predicted, round(coalesce(any_value(c.observed), 0), 6) AS observed FROM y JOIN c ON y.grp = c.grp GROUP BY y.grp",
    ),
    "td_cindex": sql(
        "scored", more=_X + ", c AS (SELECT bin, score, count(*) AS n, count(*) FILTER (cause = 1) AS d, count(*) FILTER (cause = 0) AS c0 FROM x GROUP BY bin, score)",
        body="""SELECT round(sum(a.d * b.n * (a.score > b.score)::INT) FILTER (b.bin > a.bin) / sum(a.d * b.n) FILTER (b.bin > a.bin), 6) AS concordance, CAST(sum(a.d * b.n) FILTER (b.bin > a.bin) AS BIGINT) AS pairs,
 round(sum(a.d * CASE WHEN b.bin > a.bin THEN b.n ELSE b.c0 END * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / sum(a.d * CASE WHEN b.bin > a.bin THEN b.n ELSE b.c0 END), 6) AS with_ties_and_censored, CAST(sum(a.d * CASE WHEN b.bin > a.bin THEN b.n ELSE b.c0 END) AS BIGINT) AS pairs_2 FROM c a JOIN c b ON b.bin >= a.bin AND a.d > 0""",
    ),
    "smd_table": sql("scored", body=" UNION ALL ".join(map(_smd, ("score", "score_b", "y", "k")))),
    "boot_iauroc": sql("scored", more=f"{_DRAW}, {_JOINED}, a AS ({_ia('b', 'j', 'score')}), z AS ({_ia('b', 'j', 'score_b')})", body=_Q.format("SELECT 'a' AS stat, v FROM a UNION ALL SELECT 'difference', z.v - a.v FROM a JOIN z USING (b)")),
    "boot_net_benefit": sql(
        "scored", more=f"""o AS ({_one('score DESC, id')}), {_DRAW}, g AS (SELECT b, pt, sum(wt * ((score_b >= pt)::INT - (score >= pt)::INT) * CASE WHEN y = 1 THEN 1 ELSE -pt / (1 - pt) END) / sum(wt) AS v FROM o JOIN dw USING (subject), (SELECT unnest([0.2, 0.5])::DOUBLE AS pt) GROUP BY b, pt)""",
        body=_Q.format("SELECT CASE WHEN pt < 0.3 THEN 'at_20' ELSE 'at_50' END AS stat, v FROM g"),
    ),
    "group_gate": sql("scored", more=f"g AS (SELECT *, subject % 7 AS grp FROM scored), z AS (SELECT grp, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM g GROUP BY grp)", body=f"SELECT grp AS \"group\", n, n_pos, round(v, 6) AS iauroc FROM z JOIN ({_ia('grp', 'g', 'score', '1')}) USING (grp) WHERE n >= 60 AND n_pos >= 20 AND v IS NOT NULL"),
    "group_spread": sql(
        "scored", more=f"g AS (SELECT *, subject % 7 AS grp FROM scored), z AS (SELECT grp, count(*) AS n, sum(y) AS n_pos FROM g GROUP BY grp), e AS (SELECT v FROM z JOIN ({_ia('grp', 'g', 'score', '1')}) USING (grp) WHERE n >= 100 AND n_pos >= 20 AND v IS NOT NULL)",
        body="SELECT count(*) AS n_groups, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(avg((v < 0.9)::INT), 6) AS share_below, round((SELECT max(n) / sum(n) FROM z), 6) AS largest_share FROM e",
    ),
    "density_tertiles": sql(
        "ev", "grid", "scored", more=f"""{STRICT}, {TENSOR_BINS}, c AS (SELECT key AS subject, k, count(v) / 72.0 AS density FROM b GROUP BY key, k), dj AS (SELECT * FROM scored JOIN c USING (subject, k)), q AS (SELECT quantile_cont(density, [1/3, 2/3]) AS q FROM dj),
s AS (SELECT dj.*, CASE WHEN density < q[1] THEN 'low' WHEN density < q[2] THEN 'middle' ELSE 'high' END AS tertile FROM dj, q), {draw('tertile', 's', '1')}, j AS (SELECT s.*, b, wt FROM s JOIN dw USING (tertile, subject)), bt AS ({_ia('tertile, b', 'j', 'score')}),
i AS (SELECT tertile, count(*) AS n_valid, avg(v) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM bt WHERE v IS NOT NULL GROUP BY tertile), z AS (SELECT tertile, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg((score - y) * (score - y)) AS brier FROM s GROUP BY tertile)""",
        body=f"SELECT tertile, n, n_pos, round(v, 6) AS iauroc, round(brier, 6) AS brier, coalesce(n_valid, 0) AS n_valid, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM z JOIN ({_ia('tertile', 's', 'score', '1')}) USING (tertile) LEFT JOIN i USING (tertile)",
    ),
    "boot_ci": sql("scored", more=f"{_DRAW}, {_JOINED}, a AS ({_auc('b', 'j', 'score', 'wt')}), z AS ({_auc('b', 'j', 'score_b', 'wt')})", body=_Q.format("SELECT 'a' AS stat, auroc AS v FROM a UNION ALL SELECT 'b', auroc FROM z UNION ALL SELECT 'difference', z.auroc - a.auroc FROM a JOIN z ON a.b = z.b")),
    "boot_membership_ci": sql("scored", more=f"{_MEMBER}, {_JOINED}", body=_Q.format(f"SELECT 'a' AS stat, auroc AS v FROM ({_auc('b', 'j', 'score', 'wt')})")),
    "interaction": sql(
        "scored", more=f"{_MEMBER}, {_JOINED}, a AS ({_ia('avail, b', 'j', 'score')}), z AS ({_ia('avail, b', 'j', 'score_b')}), v AS (SELECT b, max(z.v - a.v) FILTER (avail) AS on_, max(z.v - a.v) FILTER (NOT avail) AS off_ FROM a JOIN z USING (avail, b) GROUP BY b)",
        body=_Q.format("SELECT 'on' AS stat, on_ AS v FROM v UNION ALL SELECT 'off', off_ FROM v UNION ALL SELECT 'interaction', on_ - off_ FROM v"),
    ),
    "control_contrast": sql(
        "scored", more=f"""{_MEMBER}, j AS (SELECT s.*, round((score + score_b) / 2, 6) AS control, b, wt FROM scored s JOIN dw USING (subject)), jv AS (SELECT * FROM j WHERE avail), a AS ({_ia('b', 'j', 'score')}), z AS ({_ia('b', 'j', 'score_b')}), c AS ({_ia('b', 'j', 'control')}), zv AS ({_ia('b', 'jv', 'score_b')}), cv AS ({_ia('b', 'jv', 'control')}),
v AS (SELECT a.v AS a, z.v AS z, c.v AS c, zv.v - cv.v AS d FROM a JOIN z USING (b) JOIN c USING (b) LEFT JOIN zv USING (b) LEFT JOIN cv USING (b) WHERE a.v IS NOT NULL AND z.v IS NOT NULL AND c.v IS NOT NULL)""",
        body=_Q.format("SELECT 'b-a' AS stat, z - a AS v FROM v UNION ALL SELECT 'c-a', c - a FROM v UNION ALL SELECT 'b-c', z - c FROM v UNION ALL SELECT 'b-c available', d FROM v"),
    ),
    "subgroup_audit": sql(
        "scored", more=f"""s AS (SELECT *, 'age' AS dim, CASE WHEN subject % 10 < 3 THEN 'young' WHEN subject % 10 < 9 THEN 'old' ELSE 'unknown' END AS level FROM scored UNION ALL SELECT *, 'sex', CASE WHEN subject % 2 = 0 THEN 'F' ELSE 'M' END FROM scored),
{draw('dim, level', 's', '1')}, j AS (SELECT s.*, b, wt FROM s JOIN dw USING (dim, level, subject)), a AS ({_ia('dim, level, b', 'j', 'score')}), z AS ({_ia('dim, level, b', 'j', 'score_b')}), i AS (SELECT dim, level, quantile_cont(z.v - a.v, 0.025) AS low, quantile_cont(z.v - a.v, 0.975) AS high FROM a JOIN z USING (dim, level, b) WHERE z.v - a.v IS NOT NULL GROUP BY dim, level),
n AS (SELECT dim, level, count(*) AS n, count(DISTINCT subject) AS n_subjects, CAST(sum(y) AS BIGINT) AS events FROM s GROUP BY dim, level), p AS ({_ia('dim, level', 's', 'score', '1')}), o AS ({_ia('dim, level', 's', 'score_b', '1')})""",
        body="""SELECT dim, level, n, CASE WHEN n >= 100 THEN n_subjects END AS n_subjects, CASE WHEN n >= 100 THEN events END AS events, CASE WHEN n >= 100 THEN round(p.v, 6) END AS iauroc_a, CASE WHEN n >= 100 THEN round(o.v, 6) END AS iauroc_b, CASE WHEN n >= 100 THEN round(o.v - p.v, 6) END AS delta,
 CASE WHEN n >= 100 AND o.v - p.v IS NOT NULL THEN round(low, 6) END AS low, CASE WHEN n >= 100 AND o.v - p.v IS NOT NULL THEN round(high, 6) END AS high FROM n JOIN p USING (dim, level) JOIN o USING (dim, level) LEFT JOIN i USING (dim, level)""",
    ),
    "patient_dca": " UNION ALL ".join(
        "SELECT * FROM (" + sql(
            "scored", more=f"""o AS ({_one(order)}), {draw('', 'o')}, t AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS pt), g AS (SELECT b, pt, 1000 * sum(wt * ((score_b >= pt)::INT - (score >= pt)::INT) * CASE WHEN y = 1 THEN 1 ELSE -pt / (1 - pt) END) / sum(wt) AS v FROM o JOIN dw USING (subject), t GROUP BY b, pt),
i AS (SELECT pt, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.5) AS middle, quantile_cont(v, 0.975) AS high FROM g GROUP BY pt), a AS ({_nb('o', '[0.2, 0.5, 0.8]')}), z AS ({_nb('o', '[0.2, 0.5, 0.8]', '', 'score_b')}), u AS ({_auc('', 'o')}), w AS ({_auc('', 'o', 'score_b')})""",
            body=f"SELECT '{mode}' AS mode, pt, u.n AS n_patients, u.n_pos AS events, round(u.auroc, 6) AS auc_a, round(w.auroc, 6) AS auc_b, round(a.nb, 6) AS nb_a, round(z.nb, 6) AS nb_b, round((z.nb - a.nb) * 1000, 6) AS delta, round(low, 6) AS low, round(middle, 6) AS middle, round(high, 6) AS high FROM a JOIN z USING (pt) JOIN i USING (pt), u, w",
        ) + ")"
        for mode, order in (("first", "k, id"), ("highest", "score_b DESC, id"))
    ),
    "km_in_the_large": sql(
        "scored", more=f"""{_X}, s AS (SELECT *, 'all' AS level FROM x UNION ALL SELECT *, CASE WHEN k * 2 <= 3 THEN '0-3' WHEN k * 2 <= 11 THEN '4-11' ELSE '12+' END FROM x), {_MEMBER},
hz AS (SELECT unnest([4, 7]) AS horizon), c AS (SELECT level, b, bin, CAST(sum(wt) AS BIGINT) AS n, CAST(sum(wt) FILTER (cause = 1) AS BIGINT) AS d, sum(wt * score) AS p FROM s JOIN dw USING (subject) GROUP BY level, b, bin UNION ALL SELECT level, -1, bin, count(*), count(*) FILTER (cause = 1), sum(score) FROM s GROUP BY level, bin),
rk AS (SELECT *, sum(n) OVER (PARTITION BY level, b ORDER BY bin DESC) AS risk FROM c),
q AS (SELECT level, b, horizon, sum(n) AS n, sum(p) / sum(n) AS predicted, 1 - CASE WHEN bool_or(bin <= horizon AND coalesce(d, 0) = risk) THEN 0 ELSE exp(coalesce(sum(ln(1 - coalesce(d2, 0) / risk)) FILTER (bin <= horizon), 0)) END AS observed
 FROM (SELECT *, CASE WHEN coalesce(d, 0) = risk THEN NULL ELSE d END AS d2 FROM rk), hz GROUP BY level, b, horizon),
i AS (SELECT level, horizon, count(*) AS n_valid, avg(predicted - observed) AS mean, quantile_cont(predicted - observed, 0.025) AS low, quantile_cont(predicted - observed, 0.975) AS high FROM q WHERE b >= 0 GROUP BY level, horizon)""",
        body="SELECT level, horizon, CAST(n AS BIGINT) AS n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round(predicted - observed, 6) AS in_the_large, n_valid, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM q JOIN i USING (level, horizon) WHERE b = -1",
    ),
}
