"""Hourly bins over a stream: the same look-back semantics where events arrive late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_bins(events: DataFrame, delay: str = "100 minutes", width: str = "1 hour") -> DataFrame:
    """Per (key, var) and hour: count, sum and extremes, final once the watermark has passed the hour.

    events: key, var, value and a time zone timestamp `ts`; time-zone-free timestamps have no watermark, so cast before.
    """
    w = events.withWatermark("ts", delay).groupBy("key", "var", F.window("ts", width).alias("w"))
    out = w.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    return out.select("key", "var", F.col("w.start").alias("bin_start"), "n", "total", "v_min", "v_max")
