"""Signals as arrays in a column, one row per (record, lead): structure, scaling and quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of(a: Column) -> Column:
    """The mean of an array's values; null for an empty one."""
    return F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, v: F.struct((t["s"] + v).alias("s"), (t["n"] + 1).alias("n")), lambda t: F.try_divide(t["s"], t["n"]))


def sd_of(a: Column, mean: Column) -> Column:
    """Population deviation of an array about a mean."""
    return F.sqrt(mean_of(F.transform(a, lambda v: (v - mean) * (v - mean))))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def reorder(df: DataFrame, leads: list[str], length: int, lead: str = "lead", signal: str = "signal") -> DataFrame:
    """Per record: an array per named lead, cut to a length, and a mask of the leads that are there. A lead that is absent or too short is zeros and not in the mask; null and NaN values are zero."""
    cells = df.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct(lead, signal))).alias("__c"))
    own = lambda n: F.try_element_at("__c", F.lit(n))
    there = lambda n: F.coalesce(F.size(own(n)) >= length, F.lit(False))
    clean = lambda a: F.transform(F.slice(a, 1, length), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    rows = F.array(*[F.when(there(n), clean(own(n))).otherwise(F.array_repeat(F.lit(0.0), length)) for n in leads])
    return cells.select("record", rows.alias("signals"), F.array(*[there(n) for n in leads]).alias("lead_mask"))


def structural(df: DataFrame, least_leads: int, least_length: int, signal: str = "signal") -> DataFrame:
    """Per record: leads, shortest length, flat leads, and whether it passes."""
    flat = F.array_max(signal) == F.array_min(signal)
    s = df.groupBy("record").agg(F.count(F.lit(1)).alias("n_leads"), F.min(F.size(signal)).alias("length"), F.sum(F.coalesce(flat, F.lit(True)).cast("int")).alias("n_flat"))
    return s.withColumn("passed", (F.col("n_leads") >= least_leads) & (F.col("length") >= least_length) & (F.col("n_flat") < F.col("n_leads")))


def zscored(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Each record's array scaled by its own mean and deviation; NaN and null count as absent and become 0."""
    good = F.filter(signal, lambda v: v.isNotNull() & ~F.isnan(v))
    j = df.withColumn("__m", mean_of(good)).withColumn("__s", sd_of(good, F.col("__m")))
    return j.withColumn("z", F.transform(signal, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise((v - F.col("__m")) / (F.col("__s") + 1e-8)))).drop("__m", "__s")


def global_norm(train: DataFrame, by: str = "lead", signal: str = "signal") -> DataFrame:
    """Mean and deviation per lead over all values of the training records, from sums per row; NaN and null count as absent."""
    good = train.select(by, F.filter(signal, lambda v: v.isNotNull() & ~F.isnan(v)).alias("good"))
    sums = good.select(by, F.aggregate("good", F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate("good", F.lit(0.0), lambda s, v: s + v * v).alias("q"), F.size("good").alias("n"))
    g = sums.groupBy(by).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.try_divide("s", "n")
    return g.select(by, mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("sd"), "n")


def variance_of(a: Column) -> Column:
    """Population variance of an array; null for an empty one."""
    return F.aggregate(
        a, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")),
        lambda t, v: F.struct((t["n"] + 1).alias("n"), (t["m"] + (v - t["m"]) / (t["n"] + 1)).alias("m"), (t["q"] + (v - t["m"]) * (v - t["m"]) * t["n"] / (t["n"] + 1)).alias("q")),
        lambda t: F.try_divide(t["q"], t["n"]),
    )


def snr_saturation(df: DataFrame, reference: str, extreme: float = 5.0, least: int = 100, signal: str = "signal") -> DataFrame:
    """Per record: signal-to-noise in dB, and two shares of the reference lead's values.

    Signal is the mean over leads of a lead's variance, noise that of half the variance of its first differences; leads
    of fewer than `least` finite values do not count. saturated: values equal to the lead's own largest or smallest;
    extreme: values beyond an absolute bound.
    """
    good = F.filter(signal, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    n = F.size("__x")
    diff = F.when(n > 1, F.zip_with(F.slice("__x", F.lit(2), n - 1), F.slice("__x", F.lit(1), n - 1), lambda a, b: a - b))
    share = lambda c: mean_of(F.transform(signal, lambda v: F.coalesce(c(v), F.lit(False)).cast("double")))
    ref = F.col("lead") == reference
    rows = df.withColumn("__x", good).select(
        "record", F.when(n >= least, variance_of(F.col("__x"))).alias("v"), F.when(n >= least, variance_of(diff) / 2).alias("w"),
        F.when(ref, share(lambda v: (v == F.array_max("__x")) | (v == F.array_min("__x")))).alias("s"), F.when(ref, share(lambda v: F.abs(v) > extreme)).alias("x"),
    )
    snr = 10 * F.log10(F.greatest(F.avg("v"), F.lit(1e-12)) / F.greatest(F.avg("w"), F.lit(1e-12)))
    return rows.groupBy("record").agg(F.when(F.count("v") > 0, snr).alias("snr_db"), F.max("s").alias("saturated"), F.max("x").alias("extreme"))


def measurements(df: DataFrame) -> DataFrame:
    """df (rr, p_start, qrs_start, qrs_end, t_end, ...) with rate, qrs, pr, qt and qtc; a rate needs a positive rr, and a derived duration that is not positive is null."""
    c = F.col
    positive = lambda x: F.when(x > 0, x)
    rr = positive(c("rr"))
    spans = {"rate": 60000.0 / rr, "qrs": positive(c("qrs_end") - c("qrs_start")), "pr": positive(c("qrs_start") - c("p_start")), "qt": positive(c("t_end") - c("qrs_start"))}
    return df.withColumns(spans).withColumn("qtc", c("qt") / F.sqrt(rr / 1000.0))


def _each(df: DataFrame, names: dict[str, str], f, signal: str) -> DataFrame:
    """Columns that a NumPy function makes of each signal, one Arrow batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            rows = [f(np.asarray(x, np.float64)) for x in p[signal]]
            out = p[["record", "lead"]].copy()
            for i, (n, kind) in enumerate(names.items()):
                out[n] = np.array([r[i] for r in rows], np.int64 if kind == "long" else np.float64)
            yield out

    return df.select("record", "lead", signal).mapInPandas(run, "record long, lead string, " + ", ".join(f"{n} {k}" for n, k in names.items()))


def band_power(df: DataFrame, rate: float, band: tuple[float, float], whole: tuple[float, float], signal: str = "signal") -> DataFrame:
    """The power in a band over the power in a wider one."""

    def f(x):
        p, q = np.abs(np.fft.rfft(x - x.mean())) ** 2 if x.size else np.zeros(1), np.fft.rfftfreq(max(x.size, 1), 1 / rate)
        total = p[(q >= whole[0]) & (q <= whole[1])].sum()
        return (p[(q >= band[0]) & (q <= band[1])].sum() / total if total > 0 else 0.0,)

    return _each(df, {"ratio": "double"}, f, signal)


def spikes(df: DataFrame, k: float = 8.0, floor: float = 0.5, least: int = 3, signal: str = "signal") -> DataFrame:
    """Per record: second differences beyond median + k MAD of their lead (and beyond a floor), over all leads, and whether there are enough to count."""

    def f(x):
        d = np.abs(np.diff(x, 2))
        if not d.size:
            return (0,)
        m = np.median(d)
        return (int((d > max(m + k * np.median(np.abs(d - m)), floor)).sum()),)

    return _each(df, {"hits": "long"}, f, signal).groupBy("record").agg(F.sum("hits").alias("n_spikes"), (F.sum("hits") >= least).alias("spiky"))


def median_drift(df: DataFrame, width: int, signal: str = "signal") -> DataFrame:
    """Peak to peak of the moving median, the baseline's drift; beyond its ends a signal goes on as its first and last value. An even width is widened by one."""
    half = width // 2

    def f(x):
        if not x.size:
            return (0.0,)
        m = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), 2 * half + 1), axis=1)
        return (float(m.max() - m.min()),)

    return _each(df, {"drift": "double"}, f, signal)


def lead_correlation(df: DataFrame, every: int = 10, signal: str = "signal") -> DataFrame:
    """(record, median_r): the median of the absolute correlations between a record's leads, of every tenth value; 0 for a single lead. A record is one group of a few leads."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        n = min(map(len, p[signal]))
        x = np.array([np.asarray(v[:n], np.float64)[::every] for v in p[signal]])
        r = 0.0
        if len(x) > 1 and x.shape[1] > 1:
            with np.errstate(invalid="ignore", divide="ignore"):
                r = float(np.nan_to_num(np.median(np.abs(np.corrcoef(x)[np.triu_indices(len(x), 1)]))))
        return pd.DataFrame({"record": p["record"].iloc[:1], "median_r": [r]})

    return df.select("record", signal).groupBy("record").applyInPandas(f, "record long, median_r double")
