"""Assembly: code prefixes, re-based clocks, collapsed rows, aligned scores, and index tables joined from their parts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_prefix(df: DataFrame, code: str, version: str, prefixes: DataFrame) -> DataFrame:
    """df with `concepts`: those of any prefix (version, prefix, concept) that the code of that version starts with.

    Each version's prefixes are one map, and a code is looked up once for each length that they have; rows stay as they
    are, repeated ones too. Prefixes are a code list, small beside the rows.
    """
    p = prefixes.groupBy(F.col("version").alias("__v"), "prefix").agg(F.collect_set("concept").alias("c"))
    maps = p.groupBy("__v").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "c"))).alias("__m"), F.collect_set(F.length("prefix")).alias("__n"))
    j = df.join(maps, df[version] == F.col("__v"), "left")
    hits = F.flatten(F.transform(F.coalesce("__n", F.array().cast("array<int>")), lambda n: F.coalesce(F.try_element_at("__m", F.left(F.col(code), n)), F.array().cast("array<string>"))))
    return j.select(*df.columns, F.array_sort(F.array_distinct(hits)).alias("concepts"))


def time_if(member: Column, t: Column) -> Column:
    """A time where a value is in a set; null elsewhere."""
    return F.when(member, t)


def rebased(df: DataFrame, origins: DataFrame, offset: str, key: str = "stay_id") -> DataFrame:
    """df with `minute`: an offset from a stay's own start, as minutes from its episode's start. origins: (key, stay_offset, episode_offset)."""
    return df.join(origins.select(key, "stay_offset", "episode_offset"), key).withColumn("minute", F.col("stay_offset") + F.col(offset) - F.col("episode_offset")).drop("stay_offset", "episode_offset")


def collapsed(df: DataFrame, keys: list[str], columns: list[str], positive: Column) -> DataFrame:
    """One row per key: the greatest value of each column, and whether any row is positive."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns], F.max(F.coalesce(positive, F.lit(False))).alias("any_positive"), F.count(F.lit(1)).alias("n_rows"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], label: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Two score sets joined one to one, and the checks that they are: equal row counts, no lost rows, equal labels."""
    x = a.select(*keys, F.col(label).alias("y"), F.col(score).alias("score_a"))
    z = b.select(*keys, F.col(label).alias("__y"), F.col(score).alias("score_b"))
    j = x.join(z, keys)
    n = x.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(z.agg(F.count(F.lit(1)).alias("n_b"))).crossJoin(j.agg(F.count(F.lit(1)).alias("n_both"), F.count(F.when(~F.col("y").eqNullSafe(F.col("__y")), 1)).alias("n_other_label")))
    ok = (F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("n_both")) & (F.col("n_other_label") == 0)
    return j.drop("__y"), n.withColumn("aligned", ok)


def discordant(a: DataFrame, b: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The first n rows by key on which two results differ, rows of one side only included."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).orderBy(*keys).limit(n)


def steps_of(grid: DataFrame, step: int) -> DataFrame:
    """Grid rows whose time is not a step after the row before: none, if the grid is regular."""
    w = Window.partitionBy("key").orderBy("k")
    return grid.withColumns({"__k": F.lag("k").over(w), "__t": F.lag("t").over(w)}).where((F.col("k") - F.col("__k") != 1) | (F.col("t") - F.col("__t") != step)).drop("__k", "__t")


def master_index(grid: DataFrame, cohort: DataFrame, split: DataFrame, subject: str = "key") -> DataFrame:
    """The grid of included episodes with their subject's set; keyed by (key, k), never by a row number."""
    return grid.join(cohort.where("included").select(subject, "stay_id"), subject).join(split.select(subject, "set_name"), subject, "left").withColumn("set_name", F.coalesce("set_name", F.lit("excluded")))


def static_frame(master: DataFrame, context: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("key", "k"), subject: tuple[str, ...] = ("key",)) -> DataFrame:
    """One row for each row of master: what holds at its landmark (context, by keys) and what held before its stay (baseline, by subject); what is not known is null."""
    return master.join(context, list(keys), "left").join(baseline, list(subject), "left")


def masked(df: DataFrame, columns: list[str], available: Column) -> DataFrame:
    """df with the columns null where their source is not available, and an indicator `available` of 0 or 1."""
    ok = F.coalesce(available, F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)) for c in columns} | {"available": ok.cast("int")})


def packages(master: DataFrame, models: dict[str, DataFrame | None], labels: DataFrame, keys: tuple[str, ...] = ("key", "k")) -> DataFrame:
    """The index of each model: the rows of master (keys, set_name) that have what the model needs (rows of keys; None: all), with their label columns. Partition it by (model, set_name) when it is written."""
    own = [(master if needs is None else master.join(needs.select(*keys).distinct(), list(keys), "left_semi")).withColumn("model", F.lit(n)) for n, needs in models.items()]
    return reduce(DataFrame.unionByName, own).join(labels, list(keys), "left")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with other column names; a name that is not there, or that would come twice, is an error."""
    lost, new = set(names) - set(df.columns), [names.get(c, c) for c in df.columns]
    if lost or len(set(new)) < len(new):
        raise ValueError(f"cannot rename: missing {sorted(lost)}, or repeated names in {new}")
    return df.withColumnsRenamed(names)


def modality_index(index: DataFrame, selected: DataFrame, passed: DataFrame, artifact: str) -> DataFrame:
    """index with `usable`: an artifact is selected at the landmark and passes quality control."""
    j = index.join(selected.select("key", "k", artifact), ["key", "k"], "left").join(passed.select(artifact, "passed"), artifact, "left")
    return j.withColumn("usable", F.coalesce("passed", F.lit(False))).drop("passed")


def mapped(df: DataFrame, schema: dict[str, tuple[str | None, str]]) -> DataFrame:
    """df in another schema: each target column from a source column, or from nothing (Unknown for strings, null for numbers)."""

    def one(target: str, source: str | None, kind: str) -> Column:
        if source is not None and source in df.columns:
            c = F.col(source).cast(kind)
            return (F.coalesce(c, F.lit("Unknown")) if kind == "string" else c).alias(target)
        return F.lit("Unknown" if kind == "string" else None).cast(kind).alias(target)

    return df.select(*[one(t, s, k) for t, (s, k) in schema.items()])


def exclusive(df: DataFrame, columns: list[str]) -> Column:
    """Whether at most one of these columns has a value."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns]) <= 1


def whitelisted(sources: dict[str, DataFrame], contract: DataFrame) -> DataFrame:
    """The events of all sources whose (source, var) a contract admits, with the clock that it names: events or what was known."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(n)) for n, df in sources.items()])
    j = both.join(contract.select("source", "var", "clock"), ["source", "var"])
    return j.withColumn("at", F.when(F.col("clock") == "known", F.col("a")).otherwise(F.col("e")))


def normalised(column: Column) -> Column:
    """Unicode NFC, which Spark has no function for."""

    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return nfc(column)
