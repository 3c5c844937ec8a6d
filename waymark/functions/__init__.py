"""Column functions: times as integers, null-safe order, and the small scalar rules that operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
MINUTE = 60_000_000
DAY = 24 * HOUR


def micros(t: Column | str) -> Column:
    """A timestamp, with or without time zone, as microseconds since 1970."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def hours(later: Column, earlier: Column, unit: int = HOUR) -> Column:
    return (later - earlier) / F.lit(float(unit))


def floor_int(x: Column) -> Column:
    return F.floor(x).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    """The least integer not below a / b, in integers throughout."""
    return (-F.floor(-a / F.lit(b))).cast("long") if b == 1 else -((-a - F.pmod(-a, F.lit(b))) / F.lit(b)).cast("long")


def latest(value: str, *by: str) -> Column:
    """The value of the row of greatest `by` among rows that have one (max_by alone would also pick a null)."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*by)))


def overlap(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Length of the part of [start, stop) in [low, high), never negative."""
    return F.greatest(F.lit(0), F.least(stop, high) - F.greatest(start, low))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-insensitive: whether the text contains any of these; null for a null text."""
    return reduce(lambda a, b: a | b, [F.lower(text).contains(n.lower()) for n in needles])


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern, in lower case, occurs in the text of any case; a null text has no match."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(pattern)


def starts_with_any(code: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - 32.0) * 5.0 / 9.0


def as_fraction(x: Column, above: float = 1.5) -> Column:
    """Percent to fraction where the value is above what a fraction can be."""
    return F.when(x > above, x / 100.0).otherwise(x)


def parse_capped(text: Column, cap_text: str, cap: int) -> tuple[Column, Column]:
    """(number, capped) of a column that writes its top class as cap_text; null where it is no integer."""
    capped = F.trim(text) == cap_text
    return F.when(capped, cap).when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).try_cast("int")), capped


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cut(x: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """The label of the interval that x is in; closed on the right, or on the left."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed([*zip(edges, edges[1:], labels, strict=False)]):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, label).otherwise(out)
    return out


def hash_fraction(*columns: Column) -> Column:
    """A number in [0, 1) that follows from the values alone: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
