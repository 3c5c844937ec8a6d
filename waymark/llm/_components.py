"""Connected components of an edge table by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, released, stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches. A node of very many edges, as a star's centre is, is split by joined()."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, _state(e)
    while now != before and now[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "stars")
        up = joined(both.where("v > u"), low.select("u", "m"), ["u"], heavy(low, "u"))
        large = stored(up.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        down = joined(large, least.select("a", "m"), ["a"], heavy(least, "a")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = down.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        old, e = e, stored(small, "edges")
        released(old, low, large, least)
        before, now = now, _state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
