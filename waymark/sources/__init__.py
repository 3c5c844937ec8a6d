"""Sources and sinks: parquet tables in; zstd parquet, multi-track tables, CSV and check results out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Each table of a folder as a DataFrame and a temporary view."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A projected scan: only these columns are read."""
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write zstd parquet and return its row count, which is observed while writing rather than by a second scan."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["n"]


def write_tracks(tracks: Mapping[str, DataFrame], path: str, column: str = "track") -> int:
    """Several tracks of one schema in one table, partitioned by track."""
    parts = [df.withColumn(column, F.lit(k)) for k, df in tracks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return write_table(out, path, (column,))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def first_lines(stream: BinaryIO, n: int, block: int = 1 << 14) -> str | None:
    """The first n lines of an open file, of which no more is read than the blocks that hold them; None for an empty file."""
    read = b""
    while len(lines := read.splitlines(keepends=True)) <= n and (more := stream.read(block)):
        read += more
    kept = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines[:n]]
    return "\n".join(kept) if kept else None


def _opened(path: str) -> BinaryIO:
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if not path.startswith("file:") else (fs.LocalFileSystem(), unquote(urlsplit(path).path))
    return files.open_input_stream(name)


def ingest_headers(spark: SparkSession, pattern: str, done: DataFrame, header_lines: int = 1) -> DataFrame:
    """(path, header) of text files whose path is not in `done` yet: an incremental ingest that is appended to `done`. Spark lists the files; a task opens each of its files and stops after its header, so what is read does not grow with the files. Empty files have no row."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("path")).join(done.select("path"), "path", "left_anti")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b["path"].to_pylist():
                with _opened(p) as stream:
                    found.append((p, first_lines(stream, header_lines)))
            found = [x for x in found if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["path", "header"])

    return files.repartition("path").mapInArrow(heads, "path string, header string")


def scratch(spark: SparkSession) -> str:
    """A new folder for tables that are written and read again: in the one that spark.checkpoint.dir names, or, where that is unset and all is one process, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='waymark-')}/waymark-tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to a scratch folder and read again: what is read many times is computed once, and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_checks(checks: DataFrame, path: str) -> int:
    """Results (assertion, pass, detail) of quality operators, as JSON lines."""
    seen = Observation()
    checks.select("assertion", "pass", "detail").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]
