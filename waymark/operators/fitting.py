"""Fit on one set, apply to others: scalers, encoders, imputers, thresholds, tensors and models.

Fitted parameters are small DataFrames with `fitted_on`; applying is a join with them (Spark broadcasts it where it is
small), so the same code applies frozen parameters to any other source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logit
from ..sources import stored
from .quantiles import matched, quantiles

EPS = 1e-8


def fit_channels(long: DataFrame, fitted_on: str = "train", by: str = "var", value: str = "value") -> DataFrame:
    """Mean and population deviation of the observed cells of each channel."""
    return long.where(F.col(value).isNotNull()).groupBy(by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) + EPS).alias("sd"), F.count(F.lit(1)).alias("n")).withColumn("fitted_on", F.lit(fitted_on))


def scale_channels(long: DataFrame, params: DataFrame, by: str = "var", value: str = "value") -> DataFrame:
    """Standardised where observed, 0 where not."""
    j = long.join(params.select(by, "mean", "sd"), by, "left")
    return j.withColumn("scaled", F.when(F.col(value).isNotNull(), (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "sd")


def fit_columns(df: DataFrame, columns: list[str], fitted_on: str = "train") -> DataFrame:
    """(column, mean, sd, median, fitted_on) of each column; medians are exact."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), (F.stddev_pop(c) + EPS).alias("sd")).alias(c) for c in columns])
    middle = quantiles(df, [], columns, [0.5]).select("column", F.col("q")[0].alias("median"))
    return stats.unpivot([], columns, "column", "s").join(middle, "column", "left").select("column", "s.mean", "s.sd", "median", F.lit(fitted_on).alias("fitted_on"))


def _one_row(params: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    return params.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col(f))).alias(f"__{c}_{f}") for c in columns for f in fields])


def scale_columns(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(_one_row(params, columns, ["mean", "sd"])))
    return j.select(*df.columns, *[((F.col(c) - F.col(f"__{c}_mean")) / F.col(f"__{c}_sd")).alias(f"{c}_z") for c in columns])


def impute(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Medians for nulls, with an indicator each."""
    j = df.crossJoin(F.broadcast(_one_row(params, columns, ["median"])))
    return j.select(*[c for c in df.columns if c not in columns], *[F.coalesce(c, f"__{c}_median").alias(c) for c in columns], *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def fit_levels(df: DataFrame, column: str, rare: float = 0.01, fitted_on: str = "train") -> DataFrame:
    """(level, share, kept): levels of at least `rare` of the rows are kept, the others and null are Unknown."""
    n = df.groupBy(F.coalesce(column, F.lit("Unknown")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("__all")
    return n.crossJoin(n.agg(F.sum("n").alias("__all"))).select("level", share.alias("share"), ((share >= rare) & (F.col("level") != "Unknown")).alias("kept"), F.lit(fitted_on).alias("fitted_on"))


def encode_levels(df: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """df with `level`, one of the kept levels or Unknown."""
    kept = levels.where("kept").select(F.col("level").alias("__level"))
    return df.join(kept, F.col(column) == F.col("__level"), "left").withColumn("level", F.coalesce("__level", F.lit("Unknown"))).drop("__level")


def one_hot(df: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """df with a column 0 or 1 for each kept level, named column=level, and column=Unknown for all others and null. At most 1 / rare levels are kept, so their names may go through the driver."""
    names = sorted(r["level"] for r in levels.where("kept").select("level").collect())
    value = F.coalesce(F.when(F.col(column).isin(*names), F.col(column)), F.lit("Unknown")) if names else F.lit("Unknown")
    return df.withColumns({f"{column}={n}": (value == n).cast("int") for n in [*names, "Unknown"]})


def static_matrix(df: DataFrame, params: DataFrame, levels: dict[str, DataFrame], key: str, scaled: list[str], imputed: list[str]) -> DataFrame:
    """One row a key: columns imputed, scaled, encoded one-hot, with the indicators of missing values."""
    z = scale_columns(impute(df, params, imputed), params, scaled)
    for column, found in levels.items():
        z = one_hot(z, found, column)
    return z.select(key, *[f"{c}_z" for c in scaled], *[f"{c}_missing" for c in imputed], *[c for c in z.columns if any(c.startswith(f"{x}=") for x in levels)])


def fit_thresholds(long: DataFrame, k: float = 3.0, zero_inflated: tuple[str, ...] = (), by: str = "var", value: str = "value") -> DataFrame:
    """Per variable the limits median -+ k MAD; for the variables named as zero-inflated the 99th percentile above, and no limit below."""
    mid = quantiles(long, [by], [value], [0.5, 0.99]).select(by, F.col("q")[0].alias("median"), F.col("q")[1].alias("p99"))
    off = matched(long.select(by, F.col(value).cast("double").alias("__v")), mid, [by]).select(by, F.abs(F.col("__v") - F.col("median")).alias("__off"))
    mad = quantiles(off, [by], ["__off"], [0.5]).select(by, F.col("q")[0].alias("mad"))
    inflated = F.col(by).isin(*zero_inflated) if zero_inflated else F.lit(False)
    return matched(mid, mad, [by]).select(by, "median", "mad", F.when(~inflated, F.col("median") - k * F.col("mad")).alias("low"), F.when(inflated, F.col("p99")).otherwise(F.col("median") + k * F.col("mad")).alias("high"))


def passes(long: DataFrame, limits: DataFrame, by: str = "var", value: str = "value") -> DataFrame:
    """long with `passed`; a missing or NaN value fails."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.col("low").isNull() | (v >= F.col("low"))) & (v <= F.col("high"))
    return long.join(limits.select(by, "low", "high"), by, "left").withColumn("passed", F.coalesce(ok, F.lit(False))).drop("low", "high")


def subject_weights(df: DataFrame, subject: str = "subject") -> DataFrame:
    """Weights that sum to 1 for each subject."""
    return df.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(subject)))


def registry(params: dict[str, DataFrame]) -> DataFrame:
    """(name, fitted_on, n_params, content): an order-free hash of each artifact's rows, doubles to six places."""
    parts = []
    for name, p in params.items():
        text = F.concat_ws("|", *[F.coalesce((F.round(F.col(c) * 1_000_000).cast("long") if t == "double" else F.col(c)).cast("string"), F.lit("null")) for c, t in p.dtypes])
        row = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
        parts.append(p.groupBy("fitted_on").agg(F.count(F.lit(1)).alias("n_params"), F.sum(row).cast("string").alias("content")).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def sample_sets(master: DataFrame, usable: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """master with `paired` (the key is in `usable`), and a flag for each other set."""
    j = master.join(usable.select(*keys).distinct().withColumn("paired", F.lit(True)), keys, "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    return j.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


def since_last(long: DataFrame, keys: list[str], n_bins: int, cap: int) -> DataFrame:
    """For each (keys, var) and bin 0..n_bins-1: bins since the last observed one, 0 where observed, cap before the first."""
    seen = long.groupBy(*keys, "var").agg(F.collect_set("bin").alias("bins"))
    each = seen.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    last = F.array_max(F.filter("bins", lambda b: b <= F.col("bin")))
    return each.select(*keys, "var", "bin", F.least(F.coalesce(F.col("bin") - last, F.lit(cap)), F.lit(cap)).alias("delta"))


def tensors(long: DataFrame, keys: list[str], channels: list[str], n_bins: int, value: str = "value_median", cap: int = 48, recent_first: bool = False) -> DataFrame:
    """One row per key: x, m and d, each an array per channel of an array per bin, in chronological order or the most recent bin first. x is 0 where a cell is unknown, m says which are known, d counts the bins since the last known one, cap before the first.

    A key's cells are gathered by their number and laid out as a matrix (key, channel, bin) for a whole Arrow batch.
    """
    place = F.col("bin") if recent_first else n_bins - 1 - F.col("bin")
    channel = F.array_position(F.array(*map(F.lit, channels)), F.col("var")) - 1
    known = (channel >= 0) & F.col("bin").between(0, n_bins - 1) & F.col(value).isNotNull()
    cell = F.when(known, F.struct((channel * n_bins + place).cast("int").alias("i"), F.col(value).cast("double").alias("v")))
    cells = long.groupBy(*keys).agg(F.collect_list(cell).alias("cells"))
    size = len(channels) * n_bins

    def nested(flat: np.ndarray, n: int) -> pa.Array:
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n_bins, dtype=np.int32)), pa.array(flat))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(channels) + 1, len(channels), dtype=np.int32)), rows)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, held = b.num_rows, b["cells"]
            flat = held.flatten()
            at = np.repeat(np.arange(n) * size, np.diff(held.offsets.to_numpy())) + flat.field("i").to_numpy()
            x, m = np.zeros(n * size), np.zeros(n * size, bool)
            x[at], m[at] = flat.field("v").to_numpy(), True
            now = np.broadcast_to(np.arange(n_bins, dtype=np.int32), (n * len(channels), n_bins))
            last = np.maximum.accumulate(np.where(m.reshape(now.shape), now, -cap - n_bins), axis=1)
            parts = [nested(c, n) for c in (x, m, np.minimum(now - last, cap).astype(np.int32).ravel())]
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], *parts], names=[*keys, "x", "m", "d"])

    schema = T.StructType([*[cells.schema[k] for k in keys], *[T.StructField(n, T.ArrayType(T.ArrayType(t))) for n, t in (("x", T.DoubleType()), ("m", T.BooleanType()), ("d", T.IntegerType()))]])
    return cells.mapInArrow(laid_out, schema)


def balanced(df: DataFrame, label: str, weight: str) -> DataFrame:
    """df with class_weight: the weight, scaled so that both labels have half of all."""
    own = df.groupBy(label).agg(F.sum(weight).alias("__own"))  # a row a label
    return df.join(own.crossJoin(own.agg(F.sum("__own").alias("__all"))), label).withColumn("class_weight", F.col(weight) * F.col("__all") / (2 * F.col("__own"))).drop("__own", "__all")


def logistic(df: DataFrame, features: list[str], label: str, weight: str, c: float = 0.1):
    """A weighted logistic regression whose penalty is half the squared norm of the coefficients against c times the summed loss; features are taken as they are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    total = df.agg(F.sum(weight)).first()[0]
    return LogisticRegression(featuresCol="__x", labelCol=label, weightCol=weight, regParam=1 / (c * total), standardization=False, maxIter=200, tol=1e-10).fit(data)


def boosted(df: DataFrame, features: list[str], label: str, weight: str, validation: str, rounds: int = 10, seed: int = 1):
    """Boosted trees that stop when the rows marked as validation no longer gain."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    return GBTClassifier(featuresCol="__x", labelCol=label, weightCol=weight, validationIndicatorCol=validation, maxIter=rounds, maxDepth=4, seed=seed).fit(data)


def score_with(model, df: DataFrame, features: list[str]) -> DataFrame:
    """df with p, the probability of label 1: of a logistic model as an expression of its few coefficients, of others by their own function."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, LogisticRegressionModel):
        line = reduce(lambda x, y: x + y, [F.lit(float(b)) * F.col(c) for b, c in zip(model.coefficients, features, strict=True)], F.lit(float(model.intercept)))
        return df.withColumn("p", 1 / (1 + F.exp(-line)))
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    return model.transform(data).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def platt(df: DataFrame, score: str, label: str, rounds: int = 8) -> tuple[float, float]:
    """(intercept, slope) of a recalibration of logit(score), by Newton steps; rows are counted by score and label once, and each step is one pass of five sums over the counts."""
    cells = stored(df.groupBy(logit(F.col(score)).alias("x"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    x, n = F.col("x"), F.col("n")
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
        r, w = n * (F.col("y") - p), n * p * (1 - p)
        s = cells.agg(F.sum(r), F.sum(r * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        if s[0] is None:
            return 0.0, 1.0
        det = s[2] * s[4] - s[3] * s[3]
        if abs(det) < 1e-12:
            break
        a, b = a + (s[4] * s[0] - s[3] * s[1]) / det, b + (s[2] * s[1] - s[3] * s[0]) / det
    return a, b


def ensemble(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The mean score over seeds."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("n_seeds"))
