"""Tables as operator inputs, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, hash_fraction, micros
from ..operators.grid import landmark_grid

STEP, WIDTH, KMAX = 6 * HOUR, 24 * HOUR, 27
VARIABLES = ("click", "error", "login", "purchase", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delay(props) -> F.Column:
    return F.get_json_object(props, "$.k").cast("long")


def point_events(spark, d) -> DataFrame:
    """(event_id, key, e, a, kind, var, value): e the event time, a when it was known (the event time where that is not recorded)."""
    t = table(spark, d, "events")
    e = micros("ts")
    stored = F.when(F.col("event_id") % 10 != 0, e + delay("props") * MINUTE)
    return t.select("event_id", F.col("user_id").alias("key"), e.alias("e"), F.coalesce(stored, e).alias("a"), F.when(stored.isNull(), "event").otherwise("stored").alias("kind"), F.col("event_type").alias("var"), "value")


def origins(events: DataFrame) -> DataFrame:
    return events.groupBy("key").agg(F.min("e").alias("t0"), F.max("e").alias("last"))


def grid(spark, d) -> DataFrame:
    """A landmark every six hours from a user's first event, 28 at most, before the last event."""
    return landmark_grid(origins(point_events(spark, d)), STEP, KMAX, stop="last").select("key", "k", "t")


def intervals(spark, d) -> DataFrame:
    """(event_id, key, start, stop, dose, var): each event runs for k hours."""
    t = table(spark, d, "events")
    return t.select("event_id", F.col("user_id").alias("key"), micros("ts").alias("start"), (micros("ts") + delay("props") * HOUR).alias("stop"), F.col("value").alias("dose"), F.col("event_type").alias("var"))


def stays(spark, d) -> DataFrame:
    """(key, stay_id, start, stop, unit): an order is a stay of as many days as it has pieces; without lines it is open."""
    qty = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.floor(F.sum("l_quantity")).cast("long").alias("days"))
    o = table(spark, d, "orders").join(qty, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("stay_id"), micros("o_orderdate").alias("start"), (micros("o_orderdate") + F.col("days") * DAY).alias("stop"), F.col("o_orderpriority").alias("unit"))


def scored(spark, d) -> DataFrame:
    """(subject, id, k, y, score, score_b, avail): outcome y, and two scores that follow from hashes and lean towards it."""
    t = table(spark, d, "events")
    y = (F.col("value") > 60).cast("int")
    a, b = hash_fraction(F.col("event_id"), F.lit("a")), hash_fraction(F.col("event_id"), F.lit("b"))
    clean = lambda x: F.round(F.floor(x * 100) / 100 * 0.7 + y * 0.25 + 0.02, 6)
    return t.select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), (F.floor(micros("ts") / F.lit(float(DAY))) % 12).cast("int").alias("k"), y.alias("y"), clean(a).alias("score"), clean((a + b) / 2).alias("score_b"), (F.col("event_id") % 3 != 0).alias("avail"))


#: The same, for DuckDB.
SQL = {
    "ev": """ev AS (SELECT event_id, user_id AS key, epoch_us(ts) AS e,
  CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000 ELSE epoch_us(ts) END AS a,
  CASE WHEN event_id % 10 <> 0 THEN 'stored' ELSE 'event' END AS kind, event_type AS var, value FROM events)""",
    "grid": """grid AS (SELECT key, k, t0 + k * 21600000000 AS t FROM (SELECT key, min(e) AS t0, max(e) AS last_e FROM ev GROUP BY key), (SELECT unnest(generate_series(0, 27)) AS k)
  WHERE t0 + k * 21600000000 < last_e)""",
    "iv": "iv AS (SELECT event_id, user_id AS key, epoch_us(ts) AS start, epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 3600000000 AS stop, value AS dose, event_type AS var FROM events)",
    "stays": """stays AS (SELECT o_custkey AS key, o_orderkey AS stay_id, epoch_us(o_orderdate) AS start, epoch_us(o_orderdate) + days * 86400000000 AS stop, o_orderpriority AS unit
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(floor(sum(l_quantity)) AS BIGINT) AS days FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
    "scored": """scored AS (SELECT user_id AS subject, event_id AS id, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) % 12 AS k, CASE WHEN value > 60 THEN 1 ELSE 0 END AS y,
  round(floor(ha * 100) / 100 * 0.7 + (value > 60)::INT * 0.25 + 0.02, 6) AS score, round(floor((ha + hb) / 2 * 100) / 100 * 0.7 + (value > 60)::INT * 0.25 + 0.02, 6) AS score_b, event_id % 3 <> 0 AS avail
  FROM (SELECT *, ('0x' || substr(md5(event_id || ':a'), 1, 8))::BIGINT / 4294967296.0 AS ha, ('0x' || substr(md5(event_id || ':b'), 1, 8))::BIGINT / 4294967296.0 AS hb FROM events))""",
}


def sql(*names: str, more: str = "", body: str) -> str:
    """A query over these expressions (ev before grid)."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body


#: Windows of 24 hours, strict or not.
WIN = "w AS (SELECT ev.*, g.k, g.t FROM ev JOIN grid g ON ev.key = g.key AND ev.e <= g.t AND ev.e > g.t - 86400000000 {strict})"
STRICT, RETRO = WIN.format(strict="AND ev.a <= g.t"), WIN.format(strict="")


def newton(source: str, group: str, rounds: int = 8) -> str:
    """Expressions n0, n1, ... of the Newton steps of a logistic line through (x, y) of source, per group: a the intercept, b the slope."""
    steps = [f"n0 AS (SELECT {group}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM {source} GROUP BY {group})"]
    for i in range(rounds):
        sums = f"SELECT {group}, any_value(a) AS a, any_value(b) AS b, sum(y - p) AS r0, sum((y - p) * x) AS r1, sum(p * (1 - p)) AS w0, sum(p * (1 - p) * x) AS w1, sum(p * (1 - p) * x * x) AS w2 FROM (SELECT s.{group}, x, y, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM {source} s JOIN n{i} ON s.{group} = n{i}.{group}) GROUP BY {group}"
        steps.append(f"n{i + 1} AS (SELECT {group}, a + (w2 * r0 - w1 * r1) / (w0 * w2 - w1 * w1) AS a, b + (w0 * r1 - w1 * r0) / (w0 * w2 - w1 * w1) AS b FROM ({sums}))")
    return ", ".join(steps)


LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
