"""Pairing of events, reconciliation of two results, and attribution of events to stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carry import carried
from .windows import as_of


def dual_grain(a: DataFrame, b: DataFrame, before: int, after: int, day: int) -> DataFrame:
    """Each a (key, event_id, e) with its best b, whose time may be known to the day only (e null, day given).

    A b before a, by at most `before`, is preferred to one after it, by at most `after`; then the earliest. The exact and
    the day-grain rule are two joins on equality of a coarse bucket, united, instead of one join with an OR.
    """
    wide = max(before, after)
    x = a.select("key", F.col("event_id").alias("id_a"), F.col("e").alias("e_a"), F.explode(F.array(*[F.floor(F.col("e") / wide) + i for i in (-1, 0, 1)])).alias("b"))
    exact = x.join(b.where("e is not null").select("key", F.col("event_id").alias("id_b"), F.col("e").alias("e_b"), F.floor(F.col("e") / wide).alias("b")), ["key", "b"])
    gap = F.col("e_a") - F.col("e_b")
    exact = exact.select("key", "id_a", "id_b", gap.between(0, before).alias("before"), gap.between(-after, 0).alias("after"), F.lit("time").alias("grain"), F.col("e_b").alias("at"))
    n, m = before // day, after // day
    days = a.select("key", F.col("event_id").alias("id_a"), F.floor(F.col("e") / day).alias("d"), F.explode(F.sequence(F.floor(F.col("e") / day) - n, F.floor(F.col("e") / day) + m)).alias("day"))
    coarse = days.join(b.where("e is null").select("key", F.col("event_id").alias("id_b"), F.col("day").cast("long").alias("day")), ["key", "day"])
    far = F.col("d") - F.col("day")
    coarse = coarse.select("key", "id_a", "id_b", far.between(0, n).alias("before"), far.between(-m, 0).alias("after"), F.lit("day").alias("grain"), (F.col("day") * day).alias("at"))
    both = exact.unionByName(coarse).where("before or after")
    best = both.groupBy("key", "id_a").agg(F.min_by(F.struct("id_b", "grain", "before"), F.struct((~F.col("before")).alias("late"), "at", "id_b")).alias("p"))
    out = a.select("key", F.col("event_id").alias("id_a")).join(best, ["key", "id_a"], "left")
    side = F.when(F.col("p.id_b").isNull(), "none").when(F.col("p.before"), "before").otherwise("after")
    return out.select("key", "id_a", F.col("p.id_b").alias("id_b"), F.col("p.grain").alias("grain"), side.alias("side"))


def reconcile(mine: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows on both sides, on the left and on the right only, and how often the value agrees (equal, or null on both)."""
    x = mine.select(*keys, F.col(value).alias("__x"), F.lit(True).alias("__l"))
    y = theirs.select(*keys, F.col(value).alias("__y"), F.lit(True).alias("__r"))
    j = x.join(y, keys, "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return j.agg(
        F.count(F.when(both, 1)).alias("n_both"), F.count(F.when(F.col("__r").isNull(), 1)).alias("n_left"), F.count(F.when(F.col("__l").isNull(), 1)).alias("n_right"),
        F.round(F.avg(F.when(both, F.col("__x").eqNullSafe(F.col("__y")).cast("int"))), 6).alias("agreement"),
    )


def inside_any(points: DataFrame, spans: DataFrame, closed: bool = True) -> DataFrame:
    """points (key, e, ...) with `inside`: whether any span (key, start, stop) of the key holds e, both ends included (closed=False: not its stop); a null stop is open. The furthest stop so far is carried forward."""
    far = F.coalesce("stop", F.lit((1 << 63) - 1))
    starts = spans.where(F.col("start").isNotNull()).select("key", F.col("start").alias("__at"), F.lit(0).alias("__kind"), far.alias("__far"))
    both = points.withColumns({"__at": F.col("e"), "__kind": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    out = carried(both, "key", "__at", ["__kind"], {"__far": ("max", F.col("__far"))}).where("__kind = 1")
    held = F.col("__far") >= F.col("e") if closed else F.col("__far") > F.col("e")
    return out.select(*points.columns, F.coalesce(held, F.lit(False)).alias("inside"))


def attribute(tests: DataFrame, index: DataFrame, encounters: DataFrame, lead: int, most_gap: int) -> DataFrame:
    """How each test (key, event_id, e) belongs to the index encounter of its key.

    index: (key, stay_id, start, stop, visit_start, visit_stop), one row a key, with the visit that led to it; encounters:
    (key, stay_id, start, stop) of all. same_hospitalization: within it. auditable_pre_admission_encounter: before it,
    and within the visit (not before it began, not after it or the encounter's start, whichever is later), the visit's
    end and the start at most most_gap apart, at most `lead` before the start, and inside no other encounter. Else
    other_encounter inside another one, else out_of_window.
    """
    others = encounters.join(index.select("key", "stay_id"), ["key", "stay_id"], "left_anti")
    j = inside_any(tests.select("key", "event_id", "e"), others).join(index.select("key", "stay_id", "start", "stop", "visit_start", "visit_stop"), "key")
    c = F.col
    same = (c("e") >= c("start")) & (c("e") <= F.coalesce("stop", "e"))
    visit = c("visit_start").isNotNull() & (c("e") >= c("visit_start")) & (c("e") <= F.greatest("start", "visit_stop"))
    before = (c("e") < c("start")) & visit & (F.abs(c("start") - c("visit_stop")) <= most_gap) & (c("start") - c("e") <= lead) & ~c("inside")
    kind = F.when(same, "same_hospitalization").when(before, "auditable_pre_admission_encounter").when(c("inside"), "other_encounter").otherwise("out_of_window")
    return j.select("key", "event_id", "stay_id", kind.alias("attribution"))


def latest_available(grid: DataFrame, artifacts: DataFrame, fresh: dict[str, int], fresh_main: int, unit: int) -> DataFrame:
    """At each landmark the latest artifact (key, event_id, a, valid) by the time a at which it was known, freshness flags and its availability.

    Only artifacts known at the landmark compete: one that is known later neither counts nor hides an earlier one. The
    longest freshness bounds the look-back. An artifact that is not valid is found but fresh for nothing. Levels: none,
    found (not valid), stale (valid, known longer ago than fresh_main) and available.
    """
    known = artifacts.select("key", "event_id", F.col("a").alias("e"), "valid")
    x = as_of(grid, known, ["event_id", "valid"], max(fresh.values()))
    age = F.col("t") - F.col("e")
    ok = F.coalesce("valid", F.lit(False))
    level = F.when(F.col("e").isNull(), "none").when(~ok, "found").when(age <= fresh_main, "available").otherwise("stale")
    return x.select("key", "k", "event_id", *[F.coalesce(ok & (age <= most), F.lit(False)).alias(n) for n, most in fresh.items()], (age / F.lit(float(unit))).alias("hours_before"), level.alias("availability"))


def restrict(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key another set has."""
    return df.join(keys_of.select(*keys).distinct(), keys, "left_semi")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that a unique column ends."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
