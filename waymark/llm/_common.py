"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than a HEAVY-th of all rows: fewer than HEAVY, whatever the data, so a broadcast of them is bounded. FEW rows are no burden.
HEAVY, FEW = 20_000, 200
_own_folder: list[str] = []
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir. Where it is unset, one process (a local master) gets a folder of its own; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="waymark-"))
    return f"file://{_own_folder[0]}"


@contextmanager
def temporary() -> Iterator[None]:
    """Tables stored within are deleted at the end, but for those that are kept."""
    _scopes.append([])
    try:
        yield
    finally:
        released(*_scopes.pop())


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/waymark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def released(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*names: str) -> Column:
    """A key of a row's own values, two independent 64-bit hashes: rows that repeat share it and get the same result; null ids are values like any other."""
    cols = [F.col(n) for n in names]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols))]))


def heavy(counts: DataFrame, *keys: str) -> DataFrame | None:
    """The keys that hold more than a HEAVY-th of all rows and more than FEW rows; None if there are none. counts, a stored table or little else, has the keys and n, how many rows each holds. Fewer than HEAVY keys come out, so they may be broadcast."""
    r = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(r[0] / HEAVY, FEW)
    return counts.where(F.col("n") > most).select(*keys).withColumn("__hot", F.lit(True)) if r[1] > most else None


def joined(rows: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with small, which has few rows a key. The keys in hot, from heavy(), are broadcast with their rows of small; the rest meets by a shuffle in which no key is large."""
    if hot is None:
        return rows.join(small, keys, how)
    split = rows.join(F.broadcast(hot), keys, "left")
    cold = split.where("__hot is null").drop("__hot").join(small, keys, how)
    warm = split.where("__hot").drop("__hot").join(F.broadcast(small.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return cold.unionByName(warm)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8; none for null. bytes.split() splits at just these six characters."""
    return text.encode().split() if text else []


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
