"""Cohorts: index events, exclusions, splits, baselines, code maps and evidence in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contains_any, matches
from .carry import carried
from .pairing import first_of
from .windows import active_at, as_of, with_parts


def map_codes(df: DataFrame, mapping: DataFrame, code: str = "code") -> DataFrame:
    """df with `concept`: codes without a concept go. mapping: (code, concept), many codes to one."""
    return df.join(mapping.select(F.col("code").alias(code), "concept"), code)


def episode_origin(events: DataFrame, qualifies: Column) -> DataFrame:
    """Per key the earliest qualifying event (ties by event_id), how many qualify, and the status of the origin."""
    q = events.withColumn("__q", qualifies)
    first = q.groupBy("key").agg(F.min(F.when(F.col("__q"), F.struct("e", "event_id"))).alias("o"), F.count(F.when(F.col("__q"), 1)).alias("n_qualifying"), F.count(F.lit(1)).alias("n_events"))
    return first.select("key", F.col("o.e").alias("t0"), F.col("o.event_id").alias("event_id"), "n_qualifying", F.when(F.col("o").isNull(), "none").when(F.col("n_qualifying") == 1, "single").otherwise("first_of_many").alias("status"))


def index_cohort(candidates: DataFrame, minimum_age: int, exclusions: dict[str, Column], order: tuple[str, ...] = ("start", "stay_id")) -> DataFrame:
    """The first candidate of each key among those old enough, in the order of some columns, nulls last, of which the last is unique; with a flag for each exclusion and whether it is included. Exclusions may use columns that were joined, such as windows.exists_flags."""
    first = first_of(candidates.where(F.col("age") >= minimum_age), ["key"], [F.col(c).asc_nulls_last() for c in order])
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in exclusions.items()}
    out = first.select("key", "stay_id", "start", "age", *[c.alias(n) for n, c in flags.items()])
    return out.withColumn("included", reduce(lambda a, b: a & b, [~F.col(n) for n in flags], F.lit(True)))


def landmark_context(grid: DataFrame, measures: dict[str, tuple[DataFrame, int | None]], intervals: DataFrame, active: dict[str, Column], step: int) -> DataFrame:
    """At each landmark (key, k) the latest value of each measure (events, and how long it holds; None: for good), whether it is missing, and whether an interval of each kind is active."""
    parts = [as_of(grid, df, ["value"], within).select("key", "k", F.col("value").alias(n)) for n, (df, within) in measures.items()]
    on = active_at(intervals, grid, step).groupBy("key", "k").agg(*[F.max(c).alias(n) for n, c in active.items()])
    out = with_parts(grid.select("key", "k"), [*parts, on])
    return out.select("key", "k", *measures, *[F.col(n).isNull().alias(f"{n}_missing") for n in measures], *[F.coalesce(n, F.lit(False)).alias(n) for n in active])


def temporal_split(df: DataFrame, group: Column, sets: dict[str, list]) -> DataFrame:
    """df with set_name by group; a group of no set is excluded."""
    out = F.lit("excluded")
    for name, groups in sets.items():
        out = F.when(group.isin(*groups), name).otherwise(out)
    return df.withColumn("set_name", out)


def baseline(index: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """Per index row (key, stay_id, start): how many earlier rows its key has, 0 if none, and the latest known value among them, null if none. Both are carried forward, so no index row meets all history of its key."""
    past = history.where(F.col("start").isNotNull()).select("key", F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.col("stay_id").alias("__id"), F.col(value).alias("__v"), F.lit(1).alias("__one"))
    both = index.withColumns({"__at": F.col("start"), "__kind": F.lit(0)}).unionByName(past, allowMissingColumns=True)
    out = carried(both, "key", "__at", ["__kind", "__id"], {"n_prior": ("count", F.col("__one")), "last_value": ("last", F.col("__v"))}).where("__kind = 0")
    return out.select(*index.columns, "n_prior", "last_value", (F.col("n_prior") > 0).alias("has_prior"))


def evidence(sources: list[tuple[str, DataFrame, str]], patterns: dict[str, list[str]]) -> DataFrame:
    """Per source key the first row whose text contains any pattern of a concept, with the number of such rows. sources: (name, frame of key, e, text)."""
    parts = []
    for name, df, column in sources:
        for concept, needles in patterns.items():
            parts.append(df.where(contains_any(F.col(column), needles)).select("key", "e", F.lit(concept).alias("concept"), F.lit(name).alias("source")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("key", "concept").agg(F.min_by("source", F.struct("e", "source")).alias("source"), F.min("e").alias("first_e"), F.count(F.lit(1)).alias("n_evidence"))


def noted_before(index: DataFrame, notes: DataFrame, text: str, pattern: str, name: str = "noted") -> DataFrame:
    """index rows (key, until, ...) with whether a note (key, e) of the key, at `until` or before, matches the pattern. Only the first matching note of a key meets its index rows."""
    first = notes.where(matches(F.col(text), pattern)).groupBy("key").agg(F.min("e").alias("__e"))
    return index.join(first, "key", "left").withColumn(name, F.coalesce(F.col("__e") <= F.col("until"), F.lit(False))).drop("__e")


def track_membership(tracks: dict[str, DataFrame]) -> DataFrame:
    """(key, tracks, n_tracks, rule) of every key that a track has."""
    all_ = reduce(DataFrame.unionByName, [df.select("key").distinct().withColumn("track", F.lit(n)) for n, df in tracks.items()])
    out = all_.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("track")), "+").alias("tracks"), F.count(F.lit(1)).alias("n_tracks"))
    return out.withColumn("rule", F.when(F.col("n_tracks") == len(tracks), "all").when(F.col("n_tracks") > 1, "several").otherwise("single"))


def numbered(df: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """A surrogate number per key in an order that ends with a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order])))


def random_group(df: DataFrame, fraction: Column, share: float, within: Column) -> DataFrame:
    """df with `chosen`: a share of the rows that `within` admits, by a hash fraction, so that it does not depend on partitions."""
    return df.withColumn("chosen", within & (fraction < share))


def sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """n rows without replacement, the first by a hash: the same rows on every run."""
    return df.orderBy(order).limit(n)
