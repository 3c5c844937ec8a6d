"""Look-back windows over a landmark grid: (t - width, t], on two clocks.

A grid row is (key, k, t) with t = t0 + k * step. An event lies in at most ceil(width / step) windows of its key, whose
numbers follow from arithmetic; events are exploded to those numbers and joined with the grid by equality of (key, k).
No range predicate multiplies rows, and a long episode is no skewed key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import HOUR, ceil_div, hours, latest, overlap
from .carry import carried


def bounded(events: DataFrame, grid: DataFrame, margin: int, time: str = "e") -> DataFrame:
    """The events of each key from its first landmark less margin to its last landmark: a prefilter by per-key bounds."""
    b = grid.groupBy("key").agg(F.min("t").alias("__low"), F.max("t").alias("__high"))
    return events.join(b, "key").where((F.col(time) >= F.col("__low") - margin) & (F.col(time) <= F.col("__high"))).drop("__low", "__high")


def _numbered(events: DataFrame, grid: DataFrame, first: Column, last: Column, step: int) -> DataFrame:
    """events with each landmark number k of their key between two times: first <= t0 + k * step < last (null last: no bound)."""
    origin = grid.groupBy("key").agg(F.min(F.col("t") - F.col("k") * step).alias("__t0"), F.min("k").alias("__k0"), F.max("k").alias("__k1"))
    low = F.greatest(F.col("__k0").cast("long"), ceil_div(first - F.col("__t0"), step))
    high = F.least(F.col("__k1").cast("long"), ceil_div(last - F.col("__t0"), step) - 1)
    ranged = events.join(origin, "key").withColumns({"__a": low, "__b": high}).where("__a <= __b")
    return ranged.withColumn("k", F.explode(F.sequence("__a", "__b"))).drop("__t0", "__k0", "__k1", "__a", "__b")


def point_window(events: DataFrame, grid: DataFrame, width: int, step: int, clock: str | None = None) -> DataFrame:
    """Events (key, e, ...) with the grid row (k, t) of each window t - width < e <= t that holds them.

    clock names the column of the time at which an event became known; such a window is strict and holds no event that
    was not known at t. Without it the window looks back in event time alone.
    """
    joined = _numbered(events, grid, F.col("e"), F.col("e") + width, step).join(grid.select("key", F.col("k").cast("long").alias("k"), "t"), ["key", "k"])
    joined = joined.where((F.col("e") <= F.col("t")) & (F.col("e") > F.col("t") - width))
    return joined.where(F.col(clock) <= F.col("t")) if clock else joined


def overlap_window(intervals: DataFrame, grid: DataFrame, width: int, step: int) -> DataFrame:
    """Intervals (key, start, stop, ...) with each grid row whose window they overlap: start <= t and stop > t - width. A null stop is open."""
    end = F.coalesce(F.col("stop") + width, F.lit(1 << 62))
    joined = _numbered(intervals, grid, F.col("start"), end, step).join(grid.select("key", F.col("k").cast("long").alias("k"), "t"), ["key", "k"])
    return joined.where((F.col("start") <= F.col("t")) & (F.col("stop").isNull() | (F.col("stop") > F.col("t") - width)))


def active_at(intervals: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """Stabbing join: intervals with each grid row at which they are active, start <= t < stop."""
    return overlap_window(intervals, grid, 0, step)


def as_of(grid: DataFrame, events: DataFrame, values: list[str], within: int | None = None, tie: str = "event_id") -> DataFrame:
    """The grid with the latest event at or before t, at most `within` before it; ties go to the greatest tie column.

    The grid is united with the events and the last event is carried forward over each key, a hot key in stretches.
    """
    last = F.struct(*dict.fromkeys(("e", tie, *values)))
    both = events.where(F.col("e").isNotNull()).select("key", F.col("e").alias("__at"), F.lit(0).alias("__kind"), F.col(tie).cast("long").alias("__tie"), last.alias("__last")).unionByName(
        grid.select("key", F.col("t").alias("__at"), F.lit(1).alias("__kind"), "k", "t"), allowMissingColumns=True
    )
    out = carried(both, "key", "__at", ["__kind", "__tie"], {"__last": ("last", F.col("__last"))}).where("__kind = 1")
    ok = F.col("__last.e") > F.col("t") - within if within is not None else F.lit(True)
    return out.select("key", "k", "t", *[F.when(ok, F.col(f"__last.{c}")).alias(c) for c in ("e", *values)])


def hourly_bins(windowed: DataFrame, value: str = "value", unit: int = HOUR, n_bins: int = 24) -> DataFrame:
    """Per (key, k, t, var, bin): median, count, first and last event and when the last became known. Bin 0 is the most recent."""
    age = F.floor(hours(F.col("t"), F.col("e"), unit)).cast("int")
    b = F.least(age, F.lit(n_bins - 1))
    out = windowed.withColumn("bin", b).groupBy("key", "k", "t", "var", "bin").agg(
        F.median(value).alias("value_median"), F.count(value).alias("n"), F.min("e").alias("first_event"), F.max("e").alias("last_event"), F.max("a").alias("last_available"), F.min("kind").alias("kind")
    )
    return out.withColumns({"bin_start": F.col("t") - (F.col("bin") + 1) * unit, "bin_end": F.col("t") - F.col("bin") * unit})


def pivot_wide(long: DataFrame, keys: list[str], name: str, names: list[str], value: str) -> DataFrame:
    """Long to wide with the names given, so that no extra job looks for them."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def summary(windowed: DataFrame, value: str = "value", unit: int = HOUR) -> DataFrame:
    """Per (key, k, t, var): min, median, max, sd, n_obs, last value and its age in hours."""
    return windowed.groupBy("key", "k", "t", "var").agg(
        F.min(value).alias("v_min"), F.median(value).alias("v_median"), F.max(value).alias("v_max"), F.stddev(value).alias("v_sd"), F.count(value).alias("n_obs"),
        latest(value, "e", "event_id").alias("last_value"), hours(F.col("t"), F.max(F.when(F.col(value).isNotNull(), F.col("e"))), unit).alias("last_age_h"),
    )


def summary_wide(stats: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return stats.groupBy("key", "k").agg(*[F.max(F.when(F.col("var") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in columns])


def extremes(windowed: DataFrame, horizons: dict[str, int], value: str = "value") -> DataFrame:
    """Min and max within several horizons in one pass over the widest window."""
    age = F.col("t") - F.col("e")
    aggs = [f(F.when(age < h, F.col(value))).alias(f"{p}_{n}") for n, h in horizons.items() for f, p in ((F.min, "min"), (F.max, "max"))]
    return windowed.groupBy("key", "k", "var").agg(*aggs)


def exposure(joined: DataFrame, width: int, unit: int = HOUR) -> DataFrame:
    """Of overlapping intervals (start, stop, dose): hours of overlap, dose-hours, largest and median dose, and how many."""
    o = overlap(F.col("start"), F.coalesce("stop", F.col("t")), F.col("t") - width, F.col("t"))
    return joined.withColumn("o", o).groupBy("key", "k").agg(
        (F.sum("o") / F.lit(float(unit))).alias("overlap_h"), F.sum(F.col("dose") * F.col("o") / F.lit(float(unit))).alias("dose_h"), F.max("dose").alias("max_dose"), F.median("dose").alias("median_dose"), F.count(F.lit(1)).alias("n")
    )


def rebin_exposure(joined: DataFrame, width: int, mode: str = "start", unit: int = HOUR) -> DataFrame:
    """The largest dose per hour bin: of the hour in which an interval starts (earlier starts fall in the last bin), or of every hour that it overlaps."""
    last = width // unit - 1
    age = lambda at: F.least(F.floor((F.col("t") - at) / F.lit(float(unit))), F.lit(last)).cast("int")
    if mode == "start":
        binned = joined.withColumn("bin", F.greatest(F.lit(0), age(F.col("start"))))
    else:
        newest = F.greatest(F.lit(0), F.floor((F.col("t") - F.coalesce("stop", F.col("t"))) / F.lit(float(unit)))).cast("int")
        binned = joined.withColumn("bin", F.explode(F.sequence(newest, F.greatest(newest, age(F.greatest("start", F.col("t") - width + 1))))))
    return binned.groupBy("key", "k", "bin").agg(F.max("dose").alias("dose"))


def flow(windowed: DataFrame, value: str = "value") -> DataFrame:
    return windowed.groupBy("key", "k").agg(F.sum(value).alias("total"), F.median(value).alias("median"), F.max(value).alias("largest"), F.count(value).alias("n"))


def with_parts(grid: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Fan-in: aggregates per (key, k) joined to the grid, all on the same partitioning."""
    return reduce(lambda g, p: g.join(p, ["key", "k"], "left"), parts, grid)


def ratio_pairs(grid: DataFrame, a: DataFrame, b: DataFrame, within: int, unit: int = HOUR) -> DataFrame:
    """The latest a and b at or before t and their ratio, the gap between them in hours and when both were known."""
    x = as_of(grid, a, ["value", "a"], within).select("key", "k", "t", F.col("e").alias("e1"), F.col("value").alias("v1"), F.col("a").alias("a1"))
    y = as_of(grid, b, ["value", "a"], within).select("key", "k", F.col("e").alias("e2"), F.col("value").alias("v2"), F.col("a").alias("a2"))
    both = x.join(y, ["key", "k"]).where("e1 is not null and e2 is not null")
    known = F.greatest("a1", "a2")
    return both.select("key", "k", "v1", "v2", F.try_divide("v1", "v2").alias("ratio"), (F.abs(F.col("e1") - F.col("e2")) / F.lit(float(unit))).alias("gap_h"), known.alias("known"), (known <= F.col("t")).alias("eligible"))


def paired(a: DataFrame, b: DataFrame, before: int, after: int) -> DataFrame:
    """All pairs of one key with a.e - b.e in [0, before] or b.e - a.e in [0, after]."""
    x, y = a.alias("x"), b.alias("y")
    bucket = max(before, after)
    # Buckets as wide as the longer side: partners lie in the same bucket or the next, so the join is on equality.
    left = a.withColumn("__b", F.explode(F.array(*[F.floor(F.col("e") / bucket) + i for i in (-1, 0, 1)])))
    x = left.alias("x")
    y = b.withColumn("__b", F.floor(F.col("e") / bucket)).alias("y")
    gap = F.col("x.e") - F.col("y.e")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.__b") == F.col("y.__b")) & gap.between(-after, before)).select("x.key", F.col("x.event_id").alias("id_a"), F.col("y.event_id").alias("id_b"), F.col("x.e").alias("e_a"), F.col("y.e").alias("e_b"))


def earliest_pair(pairs: DataFrame) -> DataFrame:
    """Per a: the earliest b, and whether it was before or after."""
    first = F.min_by(F.struct("id_b", "e_b"), F.struct("e_b", "id_b"))
    out = pairs.groupBy("key", "id_a", "e_a").agg(first.alias("p"))
    return out.select("key", "id_a", F.col("p.id_b").alias("id_b"), F.when(F.col("p.e_b") <= F.col("e_a"), "before").otherwise("after").alias("kind"))


def exists_flags(grid: DataFrame, events: DataFrame, flags: dict[str, Column], within: int | None = None) -> DataFrame:
    """grid rows (key, t, ...) with, for each kind, whether an event (key, e) of it lies before t, and at most `within` before it. The last event of each kind is carried forward, so no event meets every row of its key."""
    names = [f"__f{i}" for i in range(len(flags))]
    points = events.where(F.col("e").isNotNull()).select("key", F.col("e").alias("__at"), F.lit(1).alias("__kind"), *[F.when(c, F.col("e")).alias(n) for n, c in zip(names, flags.values(), strict=True)])
    both = grid.withColumns({"__at": F.col("t"), "__kind": F.lit(0)}).unionByName(points, allowMissingColumns=True)
    seen = carried(both, "key", "__at", ["__kind"], {n: ("last", F.col(n)) for n in names}).where("__kind = 0")
    near = lambda n: F.col(n) >= F.col("t") - within if within is not None else F.col(n).isNotNull()
    return seen.select(*grid.columns, *[F.coalesce(near(n), F.lit(False)).alias(f) for n, f in zip(names, flags, strict=True)])
