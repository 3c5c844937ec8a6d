"""Joins of intervals with points and with one another, at any scale of time.

Each interval lies in cells as wide as a sixteenth to a half of its own length, or of one unit, so in 17 at most, and no
width is guessed from the clock or the data. A point looks into its cell of each width that some interval has (21 at
most, some seven in practice), and the two meet by equality of key, width and cell: at most two cells of an interval's
are not filled by it, so about as many pairs meet in vain as match. Times are integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an open interval ends at, the bits by which a cell is narrower than its interval at least, and those between two widths.
END, FINER, STEP = (1 << 62) - 1, 1, 3


def _cell(t: Column, level: Column) -> Column:
    """The number of the cell of width 2 ** level that holds t."""
    return F.call_function("shiftright", t.cast("long"), level)


def stabbing(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Pairs of a point and a span of equal keys with low <= at <= high, with all columns of both; a null high is open. Columns other than the keys have different names."""
    end = F.coalesce(F.col(high).cast("long"), F.lit(END))
    # The bits of the length, less some.
    length = F.greatest(end - F.col(low), F.lit(1))
    level = (F.floor(F.greatest(F.length(F.bin(length)) - 1 - FINER, F.lit(0)) / STEP) * STEP).cast("int")
    cut = spans.where((F.col(low) <= end)).withColumn("__level", level)
    cut = cut.withColumn("__cell", F.explode(F.sequence(_cell(F.col(low), F.col("__level")), _cell(end, F.col("__level")))))
    levels = spans.where(F.col(low) <= end).select(level.alias("__level")).distinct()
    # One row a level, 21 at most.
    looking = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("__cell", _cell(F.col(at), F.col("__level")))
    met = looking.join(cut, [*keys, "__level", "__cell"])
    return met.where((F.col(at) >= F.col(low)) & (F.col(high).isNull() | (F.col(at) <= F.col(high)))).drop("__level", "__cell")


def overlapping(a: DataFrame, b: DataFrame, of_a: tuple[str, str], of_b: tuple[str, str], keys: Sequence[str] = ("key",)) -> DataFrame:
    """Pairs of intervals of equal keys that share a time, both ends included, with all columns of both; a null end is open. Either b starts within a, or a starts within b and later than it."""
    one = stabbing(b, a, of_b[0], *of_a, keys)
    two = stabbing(a, b, of_a[0], *of_b, keys).where(F.col(of_a[0]) > F.col(of_b[0]))
    return one.unionByName(two.select(*one.columns))
