"""Evaluation of scored rows (subject, k, y, score, ...): discrimination, calibration, net benefit, survival, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logit
from ..sources import stored
from .quantiles import matched, quantile_row

#: Ranges of a group's scores, so that no sum over scores needs the group in one task; groups of up to FEW scores have one.
RANGES, FEW = 1024, 20_000


def ranged(cells: DataFrame, by: list[str], score: str) -> DataFrame:
    """cells with `__range`: ranges of a group's scores in their order, each of about as many cells as any other, however the scores lie; 0 in groups of few cells."""
    sketch = F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)
    bounds = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("__cells"), sketch.alias("__cuts"))
    cuts = F.when(F.col("__cells") > FEW, F.array_distinct("__cuts")).otherwise(F.array().cast("array<double>"))
    step = 32
    bounds = bounds.select(*by, cuts.alias("__cuts")).withColumn("__coarse", F.filter("__cuts", lambda x, i: i % step == 0))
    # The coarse cuts say which of the fine ones to look at.
    first = F.size(F.filter("__coarse", lambda x: x <= F.col(score)))
    within = F.size(F.filter(F.slice("__cuts", F.greatest((first - 1) * step + 1, F.lit(1)), step), lambda x: x <= F.col(score)))
    return matched(cells, bounds, by).withColumn("__range", F.when(first == 0, 0).otherwise((first - 1) * step + within)).drop("__cuts", "__coarse")


def rank_sums(cells: DataFrame, by: list[str], score: str, up: str, down: str, tie: float = 0.5) -> DataFrame:
    """(by, u, up, down): over the cells of a group (one a score, with two weights) the sum of up times the down at lower scores, a down at the same score counting `tie`. Sums go over ranges of scores, then over the ranges."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged(cells, by, score).withColumn("__low", before(down, Window.partitionBy(*by, "__range").orderBy(score)))
    parts = own.groupBy(*by, "__range").agg(F.sum(F.col(up) * (F.col("__low") + F.col(down) * tie)).alias("__u"), F.sum(up).alias("__up"), F.sum(down).alias("__down"))
    all_of = parts.withColumn("__low", before("__down", Window.partitionBy(*by).orderBy("__range")))
    return all_of.groupBy(*by).agg(F.sum(F.col("__u") + F.col("__up") * F.col("__low")).alias("u"), F.sum("__up").alias("up"), F.sum("__down").alias("down"))


def auroc(rows: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """(by, n, n_pos, auroc): the Mann-Whitney statistic with mid-ranks for ties; null with one class only. Rows are first summed per (by, score)."""
    w = F.col(weight) if weight else F.lit(1)
    cells = rows.groupBy(*by, score).agg(F.sum(w * F.col(y)).alias("__p"), F.sum(w * (1 - F.col(y))).alias("__n"))
    sums = rank_sums(cells, by, score, "__p", "__n")
    return sums.select(*by, (F.col("up") + F.col("down")).alias("n"), F.col("up").alias("n_pos"), F.try_divide("u", F.col("up") * F.col("down")).alias("auroc"))


def integrated(per_k: DataFrame, by: list[str], n_landmarks: int) -> DataFrame:
    """(by, iauroc, partial, n_estimable): the mean over landmarks, null unless all can be estimated, and the mean over those that can."""
    g = per_k.groupBy(*by).agg(F.avg("auroc").alias("partial"), F.count("auroc").alias("n_estimable"))
    return g.select(*by, F.when(F.col("n_estimable") == n_landmarks, F.col("partial")).alias("iauroc"), "partial", "n_estimable")


def brier(rows: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"), F.avg(score).alias("mean_score"), F.avg(y).alias("rate"), (F.avg(score) - F.avg(y)).alias("in_the_large"))


def quantile_bins(rows: DataFrame, score: str, n: int) -> DataFrame:
    """rows with bin 1..n by quantile edges: closed on the left, the last bin closed on both sides; equal scores share a bin."""
    edges = quantile_row(rows, score, [i / n for i in range(1, n)], "__edges")
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("__edges", lambda e: e <= F.col(score))) + 1).drop("__edges")


def calibration_curve(rows: DataFrame, score: str = "score", y: str = "y", n: int = 10) -> DataFrame:
    return quantile_bins(rows, score, n).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(y).alias("observed"))


def net_benefit(rows: DataFrame, thresholds: list[float], by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """NB(pt) = TP/n - FP/n * pt/(1 - pt), of the score and of treating all. Scores are counted per distinct value before they meet the thresholds."""
    cells = rows.groupBy(*by, score).agg(F.sum(y).alias("__p"), F.count(F.lit(1)).alias("__n"))
    t = cells.withColumn("pt", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.col(score) >= F.col("pt")
    g = t.groupBy(*by, "pt").agg(F.sum("__n").alias("n"), F.sum("__p").alias("n_pos"), F.sum(F.when(hit, F.col("__p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("__n") - F.col("__p")).otherwise(0)).alias("fp"))
    odds = F.col("pt") / (1 - F.col("pt"))
    return g.select(*by, "pt", "n", "tp", "fp", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("nb"), (F.col("n_pos") / F.col("n") - (1 - F.col("n_pos") / F.col("n")) * odds).alias("nb_all"))


def fixed_thresholds(rows: DataFrame, thresholds: list[float], a: str, b: str, y: str = "y") -> DataFrame:
    """TP and FP per 1000 rows of two scores at each threshold, and the difference in net benefit per 1000."""
    x = net_benefit(rows, thresholds, [], a, y).alias("x")
    z = net_benefit(rows, thresholds, [], b, y).alias("z")
    per = lambda s, c: (1000 * F.col(f"{s}.{c}") / F.col(f"{s}.n"))
    return x.join(z, F.col("x.pt") == F.col("z.pt")).select(F.col("x.pt").alias("pt"), per("x", "tp").alias("tp_a"), per("x", "fp").alias("fp_a"), per("z", "tp").alias("tp_b"), per("z", "fp").alias("fp_b"), ((F.col("z.nb") - F.col("x.nb")) * 1000).alias("delta_nb"))


def one_per_subject(rows: DataFrame, how: str, score: str = "score", tie: str = "id") -> DataFrame:
    """Each subject's first row by k, or the one of highest score; ties by id."""
    cols = F.struct(*[c for c in rows.columns if c != "subject"])
    row = F.min_by(cols, F.struct("k", tie)) if how == "first" else F.max_by(cols, F.struct(F.col(score), -F.col(tie)))
    return rows.groupBy("subject").agg(row.alias("r")).select("subject", "r.*")


def segments(k: Column, edges: tuple[int, ...] = (3, 11)) -> Column:
    """The segment of a landmark: up to each edge, and beyond the last."""
    first = [0, *[e + 1 for e in edges]]
    out = F.lit(f"{first[-1]}+")
    for low, high in reversed([*zip(first, edges, strict=False)]):
        out = F.when(k <= high, f"{low}-{high}").otherwise(out)
    return out


def routed(available: Column, a: Column, b: Column) -> Column:
    """The score of a where it is available, else of b."""
    return F.when(available, a).otherwise(b)


def gated(rows: DataFrame, group: str, least_n: int, least_pos: int, score: str = "score") -> DataFrame:
    """AUROC of the groups with enough rows and events."""
    return auroc(rows, [group], score).where((F.col("n") >= least_n) & (F.col("n_pos") >= least_pos) & F.col("auroc").isNotNull())


def gated_iauroc(rows: DataFrame, group: str, least_n: int, least_pos: int, n_landmarks: int, score: str = "score", y: str = "y") -> DataFrame:
    """(group, n, n_pos, iauroc) of the groups with enough rows and events whose landmarks can all be estimated."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos")).where((F.col("n") >= least_n) & (F.col("n_pos") >= least_pos))
    per = integrated(auroc(rows, [group, "k"], score, y), [group], n_landmarks).where("iauroc is not null").select(group, "iauroc")
    return matched(sizes, per, [group])


def spread(per_group: DataFrame, rows: DataFrame, group: str, floor: float, value: str = "iauroc") -> DataFrame:
    """Over the groups estimated: how many, the median and quartiles, and the share below a floor; and of all rows, estimated or not, the share of the largest group."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    found = per_group.agg(F.count(F.lit(1)).alias("n_groups"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.avg((F.col(value) < floor).cast("int")).alias("share_below"))
    largest = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("largest_share"))
    return found.crossJoin(largest)


def with_tertile(rows: DataFrame, column: str) -> DataFrame:
    cut = quantile_row(rows, column, [1 / 3, 2 / 3], "__q")
    return rows.crossJoin(F.broadcast(cut)).withColumn("tertile", F.when(F.col(column) < F.col("__q")[0], "low").when(F.col(column) < F.col("__q")[1], "middle").otherwise("high")).drop("__q")


def interval(boot: DataFrame, stats: dict[str, Column], level: float = 0.95) -> DataFrame:
    """(stat, n_valid, low, middle, high): percentile intervals over replicates."""
    q = [(1 - level) / 2, 0.5, (1 + level) / 2]
    out = boot.select(*[c.alias(n) for n, c in stats.items()]).unpivot([], list(stats), "stat", "v").where("v is not null")
    return out.groupBy("stat").agg(F.count(F.lit(1)).alias("n_valid"), F.percentile("v", q).alias("q")).select("stat", "n_valid", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def intervals(boot: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, n_valid, mean, low, middle, high) of a statistic over the replicates of each group in which it can be estimated."""
    q = F.percentile(value, [(1 - level) / 2, 0.5, (1 + level) / 2])
    g = boot.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_valid"), F.avg(value).alias("mean"), q.alias("q"))
    return g.select(*by, "n_valid", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def by_dimension(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """rows once for each dimension, with `dim` its name and `level` the row's level in it."""
    levels = F.array(*[F.struct(F.lit(n).alias("dim"), c.alias("level")) for n, c in dimensions.items()])
    return rows.select("*", F.explode(levels).alias("__d")).select(*rows.columns, "__d.dim", "__d.level")


def incidence(rows: DataFrame, cause: int, by: list[str], time: str = "bin", event: str = "cause") -> DataFrame:
    """Kaplan-Meier cumulative incidence by binned time, other causes censored; a bin in which all at risk have the event ends at 1."""
    bins = rows.groupBy(*by, time).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(event) == cause).cast("long")).alias("d"))
    part = Window.partitionBy(*by).orderBy(time)
    risk = F.sum("n").over(part.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    b = bins.withColumn("at_risk", risk)
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(upto)
    survival = F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(upto)))
    return b.select(*by, time, "at_risk", "d", (1 - survival).alias("incidence"))


def km_calibration(rows: DataFrame, cause: int, horizon: int, score: str, n: int) -> DataFrame:
    """Per quantile bin of a score predicted for this horizon: its mean and the observed incidence at the horizon. Use slope() on it."""
    b = quantile_bins(rows, score, n).withColumnRenamed("bin", "group").withColumnRenamed("time_bin", "bin")
    seen = incidence(b, cause, ["group"]).where(F.col("bin") <= horizon).groupBy("group").agg(F.max("incidence").alias("observed"))
    mean = b.groupBy("group").agg(F.avg(score).alias("predicted"), F.count(F.lit(1)).alias("n"))
    return mean.join(seen, "group", "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))


def slope(curve: DataFrame) -> DataFrame:
    return curve.agg(F.regr_slope("observed", "predicted").alias("slope"), F.regr_intercept("observed", "predicted").alias("intercept"))


def numbered(times: DataFrame, time: str) -> DataFrame:
    """(time, __i): the distinct times numbered in order, in ranges and then within one."""
    part = ranged(times.select(time).where(F.col(time).isNotNull()).distinct(), [], time)
    sizes = part.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return part.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(time)) - 1).join(starts, "__range").select(time, (F.col("__start") + F.col("__k")).cast("long").alias("__i"))


def concordance(rows: DataFrame, cause: int, time: str = "bin", score: str = "score", event: str = "cause", same_bin: bool = False, tie: float = 0.0) -> DataFrame:
    """Time-dependent concordance: over events of the cause and rows that outlast them, how often the event has the higher score; an equal one counts `tie`. same_bin also compares with rows censored in the event's own bin.

    Times are numbered and halved again and again: of two times exactly one halving has the earlier on its left and the
    later on its right, so each halving counts the lower scores on its right for the events on its left. A cell (time,
    score) takes part in as many halvings as the number of times has digits, and never meets another cell.
    """
    cells = rows.groupBy(time, score).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(event) == cause).cast("long")).alias("d"), F.sum((F.col(event) == 0).cast("long")).alias("c"))
    cells = stored(cells.where(F.col(time).isNotNull()))
    low, high = cells.agg(F.min(time), F.max(time)).first()
    if isinstance(low, int) and high - low < RANGES:  # bins, which are numbers already
        digits, placed = (high - low).bit_length(), cells.withColumn("__i", (F.col(time) - low).cast("long"))
    else:
        at = numbered(cells, time)
        digits = int(at.agg(F.coalesce(F.max("__i"), F.lit(0))).first()[0]).bit_length()
        placed = cells.join(at, time)
    left = lambda h: F.expr(f"__i >> {h} & 1") == 0
    halves = [F.struct(F.lit(h).alias("h"), F.expr(f"__i >> {h + 1}").alias("part"), F.when(left(h), F.col("d")).otherwise(0).alias("e"), F.when(left(h), 0).otherwise(F.col("n")).alias("a")) for h in range(digits)]
    own = F.struct(F.lit(-1).alias("h"), F.col("__i").alias("part"), F.col("d").alias("e"), F.col("c").alias("a"))
    parts = [*halves, *([own] if same_bin else [])]
    if not parts:
        return cells.agg(F.lit(None).cast("double").alias("concordance"), F.lit(0).cast("long").alias("pairs"))
    met = placed.select(score, F.explode(F.array(*parts)).alias("x")).select(score, "x.*").where("e > 0 or a > 0").groupBy("h", "part", score).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    t = rank_sums(met, ["h", "part"], score, "e", "a", tie).agg(F.sum("u").alias("agree"), F.coalesce(F.sum(F.col("up") * F.col("down")), F.lit(0)).alias("pairs"))
    return t.select(F.try_divide("agree", "pairs").alias("concordance"), "pairs")


def calibration_line(rows: DataFrame, by: list[str], rounds: int = 8, score: str = "score", y: str = "y") -> DataFrame:
    """(by, slope, intercept) of the logistic recalibration of a score, for each group, by Newton steps over grouped sums; null where a group has one class. Rows are counted by score and outcome once, and the steps go over the counts."""
    base = stored(rows.groupBy(*by, F.col(y).alias("__y"), logit(F.col(score)).alias("__x")).agg(F.count(F.lit(1)).alias("__n")))
    rate = F.sum(F.col("__y") * F.col("__n")) / F.sum("__n")
    at = base.groupBy(*by).agg(rate.alias("__rate")).select(*by, F.when((F.col("__rate") > 0) & (F.col("__rate") < 1), 0.0).alias("intercept"), F.lit(1.0).alias("slope"))
    for _ in range(rounds):
        x, n = F.col("__x"), F.col("__n")
        p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * x)))
        r, w = n * (F.col("__y") - p), n * p * (1 - p)
        g = matched(base, at, by).groupBy(*by).agg(F.first("intercept").alias("a"), F.first("slope").alias("b"), F.sum(r).alias("r0"), F.sum(r * x).alias("r1"), F.sum(w).alias("w0"), F.sum(w * x).alias("w1"), F.sum(w * x * x).alias("w2"))
        det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
        at = g.select(*by, (F.col("a") + F.try_divide(F.col("w2") * F.col("r0") - F.col("w1") * F.col("r1"), det)).alias("intercept"), (F.col("b") + F.try_divide(F.col("w0") * F.col("r1") - F.col("w1") * F.col("r0"), det)).alias("slope"))
    return at.select(*by, "slope", "intercept")


def standardised_differences(rows: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """(column, mean_1, mean_0, smd): differences of means over the pooled deviation between the two groups."""
    g = rows.withColumn("__g", group)
    aggs = [F.struct(*[f(F.when(F.col("__g") == b, F.col(c).cast("double"))).alias(f"{n}{i}") for i, b in ((1, True), (0, False)) for n, f in (("m", F.avg), ("v", F.variance))]).alias(c) for c in columns]
    s = g.agg(*aggs).unpivot([], columns, "column", "s")
    return s.select("column", F.col("s.m1").alias("mean_1"), F.col("s.m0").alias("mean_0"), F.try_divide(F.col("s.m1") - F.col("s.m0"), F.sqrt((F.col("s.v1") + F.col("s.v0")) / 2)).alias("smd"))
