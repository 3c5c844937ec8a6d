"""Queries that read and write tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..operators import quality as Q
from ..operators import windows as W
from .fixtures import RETRO, STEP, STRICT, WIDTH, grid, point_events, sql, stays


def loaded_views(spark, d):
    """Two tables as views, joined in SQL."""
    S.load_tables(spark, d, ["nation", "region"])
    return spark.sql("SELECT r_name, count(*) AS n, min(n_name) AS first_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def projected_scan(spark, d):
    return S.scan(spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def table_sink(spark, d):
    """Stays written as a table: the rows counted while writing beside those read again."""
    path = S.scratch(spark)
    n = S.write_table(stays(spark, d), path)
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("n_written"), F.count(F.lit(1)).alias("n_read"), F.count("stop").alias("n_closed"))


def track_sink(spark, d):
    """Strict and retro windows in one table, by track."""
    path, g, e = S.scratch(spark), grid(spark, d), point_events(spark, d)
    tracks = {n: W.point_window(e, g, WIDTH, STEP, clock=c).select("key", "k", "event_id") for n, c in (("strict", "a"), ("retro", None))}
    S.write_tracks(tracks, path)
    return spark.read.parquet(path).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key", "k").alias("n_landmarks"))


def csv_sink(spark, d):
    path = S.scratch(spark)
    S.write_csv(S.scan(spark, f"{d}/supplier.parquet", ["s_suppkey", "s_name"]), path)
    return spark.read.option("header", True).schema("s_suppkey long, s_name string").csv(path)


def check_sink(spark, d):
    path, g = S.scratch(spark), grid(spark, d)
    windows = W.point_window(point_events(spark, d), g, WIDTH, STEP)
    S.write_checks(Q.together([Q.unique("grid", g, ["key", "k"]), Q.no_leakage(windows)]), path)
    return spark.read.schema("assertion string, pass boolean, detail string").json(path)


def header_ingest(spark, d):
    """The first two lines of each file of orders, a file holding a range of their keys, without the files that were ingested before."""
    path, size = S.scratch(spark), 4000
    o = S.scan(spark, f"{d}/orders.parquet", ["o_orderkey"]).select(F.floor(F.col("o_orderkey") / size).alias("part"), F.col("o_orderkey").cast("string").alias("value"))
    o.repartition("part").sortWithinPartitions("part", F.col("value").cast("long")).write.partitionBy("part").text(path)
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
    every = spark.read.format("binaryFile").load(f"{path}/*").select(F.col("_metadata.file_path").alias("path"))
    return S.ingest_headers(spark, f"{path}/*", every.where(part % 3 == 2), 2).select(part.alias("part"), "header")


QUERIES = {f.__name__: f for f in (loaded_views, projected_scan, table_sink, track_sink, csv_sink, check_sink, header_ingest)}

ORACLES = {
    "loaded_views": "SELECT r_name, count(*) AS n, min(n_name) AS first_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "projected_scan": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag",
    "table_sink": sql("stays", body="SELECT count(*) AS n_written, count(*) AS n_read, count(stop) AS n_closed FROM stays"),
    "track_sink": sql("ev", "grid", more=STRICT + ", r" + RETRO[1:], body="SELECT 'strict' AS track, count(*) AS n, count(DISTINCT (key, k)) AS n_landmarks FROM w UNION ALL SELECT 'retro', count(*), count(DISTINCT (key, k)) FROM r"),
    "csv_sink": "SELECT s_suppkey, s_name FROM supplier",
    "check_sink": sql("ev", "grid", more=RETRO, body="SELECT 'grid' AS assertion, count(*) FILTER (n > 1) = 0 AS pass, CAST(count(*) FILTER (n > 1) AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM grid GROUP BY key, k) UNION ALL SELECT 'known_at_landmark', count(*) FILTER (a > t) = 0, CAST(count(*) FILTER (a > t) AS VARCHAR) FROM w"),
    "header_ingest": "SELECT part, string_agg(o_orderkey, chr(10) ORDER BY o_orderkey) AS header FROM (SELECT o_orderkey // 4000 AS part, o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 2 AND part % 3 <> 2 GROUP BY part",
}
