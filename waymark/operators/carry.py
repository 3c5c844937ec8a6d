"""Values carried along the rows of a key, where one key may hold any share of all rows.

Rows of most keys are carried in one sort. The rows of a hot key are cut into stretches of time of about as many rows,
carried within each, and what a stretch leaves behind is carried over the stretches of the key, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .quantiles import matched

#: A key is hot if it has more than a HEAVY-th of all rows and more than STRETCH: there are fewer than HEAVY such keys, and as few stretches of all of them. A stretch has about STRETCH rows or a HEAVY-th of all.
HEAVY, STRETCH = 10_000, 200_000


def hot_keys(rows: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """(key, __n) of the hot keys, None if there are none, and the rows of a stretch."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = n.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    least = max(total // HEAVY, STRETCH)
    return (n.where(F.col("__n") > least) if most > least else None), least


def carried(rows: DataFrame, key: str, at: str, order: Sequence[str], values: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """rows with each value: an aggregate (last: the last that is not null; max, min, sum or count) of a column over the key's rows up to this one, in the order of `at` and then `order`; or, backwards, over this row and those after it in time.

    values: name to ("last", "max", "min", "sum" or "count", column). The order ends with what tells rows apart.
    """
    first = F.col(at).desc() if backwards else F.col(at).asc()
    along = [first, *order]

    def run(c: Column, kind: str, w: WindowSpec) -> Column:
        return (F.last(c, ignorenulls=True) if kind == "last" else {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[kind](c)).over(w)

    def within(df: DataFrame, *parts: str) -> DataFrame:
        w = Window.partitionBy(key, *parts).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: run(c, kind, w) for n, (kind, c) in values.items()})

    hot, least = hot_keys(rows, key)
    if hot is None:
        return within(rows)
    marked = matched(rows, F.broadcast(hot.select(key)).withColumn("__hot", F.lit(True)), [key], "left")
    cold, warm = within(marked.where("__hot is null").drop("__hot")), marked.where("__hot").drop("__hot")
    # Hot keys' times at equal shares of their rows; their number is the number of stretches.
    points = F.percentile_approx(at, [i / 1024 for i in range(1, 1024)], 10_000)
    every = F.greatest(F.lit(1), F.floor(F.lit(1024 * least) / F.count(F.lit(1))).cast("int"))
    cuts = warm.groupBy(key).agg(points.alias("__cuts"), every.alias("__every")).select(key, F.array_distinct(F.filter("__cuts", lambda x, i: (i + 1) % F.col("__every") == 0)).alias("__cuts"))
    placed = matched(warm, F.broadcast(cuts), [key]).withColumn("__part", F.size(F.filter("__cuts", lambda x: x <= F.col(at)))).drop("__cuts")
    part = within(placed, "__part")
    # What a stretch leaves behind: the value at its last row, from the values of its rows.
    place = F.struct((-F.col(at) if backwards else F.col(at)).alias("at"), *order)
    ends = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)), "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    left = placed.groupBy(key, "__part").agg(*[ends[kind](c).alias(n) for n, (kind, c) in values.items()])
    over = Window.partitionBy(key).orderBy(F.col("__part").desc() if backwards else F.col("__part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = left.select(key, "__part", *[run(F.col(n), "sum" if kind == "count" else kind, over).alias(f"__before_{n}") for n, (kind, _) in values.items()])
    both = {"last": lambda x, y: F.coalesce(x, y), "max": F.greatest, "min": F.least, "sum": lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), "count": lambda x, y: x + F.coalesce(y, F.lit(0))}
    joined = matched(part, before, [key, "__part"])
    out = joined.withColumns({n: both[kind](F.col(n), F.col(f"__before_{n}")) for n, (kind, _) in values.items()})
    return cold.unionByName(out.select(*cold.columns))

