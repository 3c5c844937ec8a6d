"""Landmark grids: regular decision times over episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ceil_div


def landmark_grid(cohort: DataFrame, step: int, kmax: int, main_kmax: int | None = None, start: str = "t0", stop: str | None = None, origin: str = "t0") -> DataFrame:
    """cohort with a row for each landmark t = origin + k * step, k0 <= k <= kmax and t before `stop` (null: no end).

    k0 = max(0, ceil((start - origin) / step)). Only valid numbers are generated; nothing is crossed and filtered after.
    """
    k0 = F.greatest(F.lit(0), ceil_div(F.col(start) - F.col(origin), step))
    last = F.lit(kmax).cast("long")
    if stop is not None:
        last = F.least(last, ceil_div(F.col(stop) - F.col(origin), step) - 1)
    rows = cohort.withColumns({"k0": k0.cast("long"), "__last": last}).where("k0 <= __last").withColumn("k", F.explode(F.sequence("k0", "__last"))).drop("__last")
    out = rows.withColumn("t", F.col(origin) + F.col("k") * step)
    return out.withColumn("main", F.col("k") <= main_kmax) if main_kmax is not None else out
