"""Exact quantiles of whole tables, many at once, without a task that holds a table's values.

Selection by refinement: a sketch of a group's values brackets each rank, a pass over the table counts exactly what lies
below the bracket and at its ends, and sketches what lies inside, where the next, narrower bracket is. Each pass leaves
about three thousandths of the values inside, whatever their distribution; when few enough are left they are listed,
and the ranks are read from them. Values that repeat are counted, not listed. Nothing but sketches and counts is
shuffled. A billion rows need two passes and the list, a million one and the list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stored

#: Points of a sketch, its accuracy (ranks are right to a share of 1 / ACCURACY), and the values that a bracket may list.
STEPS, ACCURACY, LISTED = 1000, 10_000, 50_000
#: What a bracket of three steps holds at most, with the sketch's error on both sides.
_SHARE = 3 / STEPS + 2 / ACCURACY


def matched(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a with b's other columns, by equality of the keys, nulls included; of b's one row if there are no keys."""
    right = b.select(*[F.col(c).alias(f"__r_{c}") for c in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]) if keys else F.lit(True)
    return a.join(right, on, how).drop(*[f"__r_{c}" for c in keys])


def _sketch(v: Column) -> Column:
    return F.percentile_approx(v, [i / STEPS for i in range(STEPS + 1)], ACCURACY)


def _rank(p: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(p)).cast("long")


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], listed: int = LISTED) -> DataFrame:
    """(by, column, n, q): of each group and column how many values it has, and the array of their quantiles, interpolated between ranks; nulls do not count, NaN is the greatest value. A group without a value of a column has no row for it."""
    group = [*by, "column"]
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "column", "v").where("v is not null")
    whole = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.isnan("v"), 1)).alias("m"), _sketch(F.when(~F.isnan("v"), F.col("v"))).alias("s"))
    around = [min(int(p * STEPS), STEPS - 1) for p in probabilities]
    # Groups of a few values a step are listed whole.
    few = max(listed, 4 * STEPS)
    ends = lambda name, i, whole: F.when(F.col("n") <= few, F.col("s")[whole]).otherwise(F.col("s")[i]).alias(name)
    state = stored(whole.select(*group, "n", "m", *[ends(f"lo{k}", max(i - 1, 0), 0) for k, i in enumerate(around)], *[ends(f"hi{k}", min(i + 2, STEPS), STEPS) for k, i in enumerate(around)]))
    most = (state.where(F.col("n") > few).agg(F.max("n")).first()[0] or 0) * _SHARE
    index, v = range(len(around)), F.col("v")
    inside = [(v > F.col(f"lo{k}")) & (v < F.col(f"hi{k}")) for k in index]
    below = [F.count(F.when(v < F.col(f"lo{k}"), 1)).alias(f"below{k}") for k in index]
    low = [F.count(F.when(v == F.col(f"lo{k}"), 1)).alias(f"low{k}") for k in index]
    high = [F.count(F.when((v == F.col(f"hi{k}")) & (v > F.col(f"lo{k}")), 1)).alias(f"high{k}") for k in index]
    edges = [F.first(c).alias(c) for k in index for c in (f"lo{k}", f"hi{k}")]
    while most > few:
        g = matched(long, state, group).groupBy(*group).agg(F.first("n").alias("n"), F.first("m").alias("m"), *edges, *below, *low, *[F.count(F.when(c, 1)).alias(f"held{k}") for k, c in enumerate(inside)], *[_sketch(F.when(c, v)).alias(f"s{k}") for k, c in enumerate(inside)])
        narrow = []
        for k, p in enumerate(probabilities):
            at = F.floor(STEPS * F.try_divide(_rank(p) - F.col(f"below{k}") - F.col(f"low{k}"), F.col(f"held{k}"))).cast("int")
            s, wide = F.col(f"s{k}"), F.col(f"held{k}") > few
            narrow += [F.when(wide & (at >= 1), F.try_element_at(s, F.least(at, F.lit(STEPS + 1)))).otherwise(F.col(f"lo{k}")).alias(f"lo{k}"), F.when(wide & (at + 2 <= STEPS), F.try_element_at(s, F.greatest(at + 3, F.lit(1)))).otherwise(F.col(f"hi{k}")).alias(f"hi{k}")]
        state = stored(g.select(*group, "n", "m", *narrow))
        most *= _SHARE
    g = matched(long, state, group).groupBy(*group).agg(F.first("n").alias("n"), F.first("m").alias("m"), *edges, *below, *low, *high, *[F.array_sort(F.collect_list(F.when(c, v))).alias(f"held{k}") for k, c in enumerate(inside)])

    def at(k: int, rank: Column) -> Column:
        place = rank - F.col(f"below{k}") - F.col(f"low{k}")
        missed = F.raise_error(F.lit("a sketch missed its rank")).cast("double")
        return F.when(rank >= F.col("m"), F.lit(float("nan"))).when(rank < F.col(f"below{k}"), missed).when(place < 0, F.col(f"lo{k}")).when(place < F.size(f"held{k}"), F.get(f"held{k}", place.cast("int"))).when(place < F.size(f"held{k}") + F.col(f"high{k}"), F.col(f"hi{k}")).otherwise(missed)

    def value(k: int, p: float) -> Column:
        r = _rank(p)
        part = (F.col("n") - 1) * F.lit(p) - r
        a, b = at(k, r), at(k, F.least(r + 1, F.col("n") - 1))
        return F.when((part == 0) | (a == b), a).otherwise((1 - part) * a + part * b)

    return g.select(*group, "n", F.array(*[value(k, p) for k, p in enumerate(probabilities)]).alias("q"))


def quantile_row(df: DataFrame, column: str, probabilities: Sequence[float], name: str) -> DataFrame:
    """One row with the array `name` of a column's quantiles, null where it has no value."""
    q = quantiles(df, [], [column], probabilities)
    return q.agg(F.first("q").alias(name))
