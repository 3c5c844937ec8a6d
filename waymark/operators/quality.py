"""Data quality: violations of contracts, as rows (assertion, pass, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import matched, quantiles


def check(name: str, df: DataFrame, violation: Column) -> DataFrame:
    """One assertion: no row is a violation; detail counts them."""
    n = F.count(F.when(violation, 1))
    return df.agg(F.lit(name).alias("assertion"), (n == 0).alias("pass"), n.cast("string").alias("detail")).select("assertion", "pass", "detail")


def together(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def schema_contract(df: DataFrame, expected: list[str], required: list[str] = ()) -> DataFrame:
    """Columns that are missing, columns that nobody asked for, and rows in which a required column is null."""
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    said = [F.lit(x) for x in ("no_missing_columns", not missing, ",".join(missing), "no_extra_columns", not extra, ",".join(extra))]
    names = df.agg(F.count(F.lit(1)).alias("__n")).select(F.explode(F.array(*[F.struct(a.alias("assertion"), b.alias("pass"), c.alias("detail")) for a, b, c in (said[:3], said[3:])])).alias("x")).select("x.*")
    there = [F.col(c).isNull() for c in required if c in df.columns]
    return names.unionByName(check("required_not_null", df, reduce(lambda x, y: x | y, there, F.lit(False))))


def ordered(name: str, df: DataFrame, low: str, high: str) -> DataFrame:
    """Intervals end where they start or later; an open one does."""
    return check(name, df, F.col(high) < F.col(low))


def after_landmark(name: str, df: DataFrame, time: str, t: str = "t") -> DataFrame:
    """Outcomes lie after their landmark."""
    return check(name, df, F.col(time) <= F.col(t))


def until_landmark(name: str, df: DataFrame, time: str, t: str = "t") -> DataFrame:
    """Artifacts and values lie at their landmark or before it."""
    return check(name, df, F.col(time) > F.col(t))


def within_one(name: str, df: DataFrame, part: str, whole: str) -> DataFrame:
    """A part belongs to one whole only: no episode spans two admissions, no stay two episodes."""
    return check(name, df.groupBy(part).agg(F.countDistinct(whole).alias("__n")), F.col("__n") > 1)


def unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return check(name, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), F.col("__n") > 1)


def row_counts(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Tables that must have as many rows as another."""
    out = []
    for name, a, b in pairs:
        n = a.agg(F.count(F.lit(1)).alias("n")).crossJoin(b.agg(F.count(F.lit(1)).alias("m")))
        out.append(n.select(F.lit(name).alias("assertion"), (F.col("n") == F.col("m")).alias("pass"), F.concat_ws("/", F.col("n").cast("string"), F.col("m").cast("string")).alias("detail")))
    return together(out)


def no_leakage(windowed: DataFrame, known: str = "a", t: str = "t") -> DataFrame:
    """Nothing in a window became known after its landmark."""
    return check("known_at_landmark", windowed, F.col(known) > F.col(t))


def contained(bins: DataFrame, unit: int, n_bins: int = 24) -> DataFrame:
    """Events lie in their bins: first and last within (bin_start, bin_end], the most recent bin closed at both ends."""
    return check("events_in_bins", bins, (F.col("first_event") <= F.col("bin_start")) & (F.col("bin") < n_bins - 1) | (F.col("last_event") > F.col("bin_end")) | (F.col("bin_end") - F.col("bin_start") != unit))


def pure_split(df: DataFrame, subject: str, name: str) -> DataFrame:
    """A subject is in one set only."""
    return check("subject_in_one_set", df.groupBy(subject).agg(F.countDistinct(name).alias("__n")), F.col("__n") > 1)


def fitted_on(params: DataFrame, expected: str = "train") -> DataFrame:
    return check("fitted_on_" + expected, params, F.col("fitted_on") != expected)


def mask_policy(tensors: DataFrame) -> DataFrame:
    """No NaN in x, and x is 0 where m is false."""
    nan = F.exists(F.flatten("x"), lambda v: F.isnan(v) | v.isNull())
    off = F.exists(F.zip_with(F.flatten("x"), F.flatten("m"), lambda v, m: ~m & (v != 0)), lambda b: b)
    return together([check("no_nan", tensors, nan), check("masked_is_zero", tensors, off)])


def state_space(name: str, df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """All values are among those allowed; detail names the others."""
    other = df.where(~F.col(column).isin(allowed) | F.col(column).isNull()).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce(column, F.lit("null")))), ",").alias("d"))
    return other.select(F.lit(name).alias("assertion"), (F.col("d") == "").alias("pass"), F.col("d").alias("detail"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables carry the same key set, by order-free hashes of their distinct keys."""
    h = lambda df, n: df.select(*keys).distinct().agg(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias(n))
    return h(a, "x").crossJoin(h(b, "y")).select(F.lit("same_keys").alias("assertion"), F.col("x").eqNullSafe(F.col("y")).alias("pass"), F.lit("").alias("detail"))


def profile(long: DataFrame, by: list[str], low: Column, high: Column, value: str = "value", exact: bool = True) -> DataFrame:
    """Per group n, median, quartiles, 1st and 99th percentile, extremes and the share out of range; exact, or by sketches alone."""
    q = [0.01, 0.25, 0.5, 0.75, 0.99]
    sketched = [] if exact else [F.percentile_approx(value, q).alias("q")]
    out = long.groupBy(*by).agg(F.count(value).alias("n"), *sketched, F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.avg(((F.col(value) < low) | (F.col(value) > high)).cast("int")).alias("outside"))
    if exact:
        out = matched(out, quantiles(long, by, [value], q).drop("column", "n"), by)
    return out.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "q1", "median", "q3", "p99"))], (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "v_min", "v_max", "outside")


def equivalence(a: DataFrame, b: DataFrame, by: list[str], most_shift: float = 0.15, most_outside: float = 0.05) -> DataFrame:
    """Two profiles graded: A where medians differ by at most a share and few values are out of range on either side, else B."""
    x, y = a.alias("x"), b.alias("y")
    shift = F.abs(F.col("x.median") - F.col("y.median")) / F.greatest(F.abs(F.col("x.median")), F.lit(1e-9))
    ok = (shift <= most_shift) & (F.greatest("x.outside", "y.outside") <= most_outside)
    return x.join(y, by).select(*by, shift.alias("shift"), F.greatest("x.outside", "y.outside").alias("outside"), F.when(ok, "A").otherwise("B").alias("grade"))


def gates(stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """stats (track, metric, value) against thresholds (metric, least): one row per gate, and go per track only if all pass."""
    j = stats.join(thresholds, "metric").withColumn("pass", F.col("value") >= F.col("least"))
    go = j.groupBy("track").agg(F.every("pass").alias("go"))
    return j.join(go, "track").select("track", "metric", "value", "least", "pass", "go")


def flow(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, n, n_subjects) after each step of a chain of filters, in one pass."""
    aggs, ok = [], F.lit(True)
    for i, (name, c) in enumerate(steps):
        ok = ok & F.coalesce(c, F.lit(False))
        aggs.append(F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.count(F.when(ok, 1)).alias("n"), F.countDistinct(F.when(ok, F.col("key"))).alias("n_subjects")).alias(f"s{i}"))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def largest_share(df: DataFrame, group: str) -> DataFrame:
    """The share of the rows that the largest group has."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("share"))
