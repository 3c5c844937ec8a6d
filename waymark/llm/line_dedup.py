"""Operator 8: line dedup by sharded cuckoo filters over exact reference counts.

The exact state is the reference table (rid, doc_id, h1, h2): one row per document and distinct long line key, the key
being two independent 64-bit hashes. insert() appends rows to it and delete() takes a document's rows out, so every
step can be undone. reference_counts() sums it to (h1, h2, n, n_docs, last_doc). build_filters() turns the keys that
are to be dropped into one cuckoo filter per shard; update_filters() inserts and deletes single keys in them. probe()
routes the references of documents by shard past that shard's filter. A filter has no false negatives, so lines that
it does not know are kept without a look at the exact table; only those that it knows meet that table, which decides.
Any number of shards works alike: no filter is broadcast, and none is held beside another.

Defined results: a null or empty text is one empty line; rows of one doc_id, repeated or not, are one document, and so
are all rows with a null doc_id, which is smaller than every id: of a line's holders one document always keeps it. A
very long text is one row like any other. Columns of docs pass through; names that begin with __ are this operator's
(__rid, __drops, __n_lines, __n_dropped). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, row_key, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in one shard, references that one copy of a filter meets, and such copies in one task (expected): several, so that tasks come out alike.
SHARD_KEYS, TASK_ROWS, TASK_COPIES = 250_000, 50_000, 4
_SLOTS, _KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints in buckets of four; a key is a pair of uint64 hashes."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n_keys: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / _SLOTS / 0.8)))))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (h2 % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = (h1 & np.uint64(self.n - 1)).astype(np.int64)
        return print_, a, self._other(a, print_)

    def _other(self, at, print_):
        return at ^ ((print_.astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        f, a, b = self._places(h1, h2)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if some key found no place; the caller then builds a larger filter."""
        for f, a, b in zip(*self._places(h1, h2), strict=True):
            for at in (a, b):
                if (free := np.flatnonzero(self.table[at] == 0)).size:
                    self.table[at, free[0]] = f
                    break
            else:
                at = a
                for kick in range(_KICKS):
                    slot = (int(f) + kick) % _SLOTS
                    self.table[at, slot], f = f, self.table[at, slot]
                    at = self._other(at, f)
                    if (free := np.flatnonzero(self.table[at] == 0)).size:
                        self.table[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; the keys must have been inserted."""
        for f, a, b in zip(*self._places(h1, h2), strict=True):
            for at in (a, b):
                if (there := np.flatnonzero(self.table[at] == f)).size:
                    self.table[at, there[0]] = 0
                    break


def line_key(line: bytes) -> bytes:
    """bytes.strip() and bytes.lower() know ASCII only."""
    return line.strip().lower()


def _is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1)


def _long_keys(text: str | None, min_chars: int) -> list[tuple[int, int]]:
    keys = set(map(line_key, (text or "").encode().split(b"\n")))
    return [_hashes(k) for k in keys if _is_long(k, min_chars)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def line_references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, doc_id, h1, h2): a row per row of docs and distinct key of at least min_chars code points. rid is row_key(doc_id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, i) for i, t in enumerate(b.column("text").to_pylist()) for h in _long_keys(t, min_chars)]
            at = pa.array([i for _, i in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid").take(at), b.column("doc_id").take(at), pa.array(_signed([h[0] for h, _ in found])), pa.array(_signed([h[1] for h, _ in found]))], ["rid", "doc_id", "h1", "h2"])

    return docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long"), "text").mapInArrow(emit, "rid binary, doc_id long, h1 long, h2 long")


def insert(references: DataFrame, docs: DataFrame) -> DataFrame:
    """The references after these documents came in."""
    return references.unionByName(line_references(docs))


def delete(references: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The references after the documents of these ids (null is one) went out: what insert() added is gone again."""
    gone = doc_ids.select(F.col("doc_id").alias("__id")).distinct()
    return references.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def reference_counts(references: DataFrame) -> DataFrame:
    """(h1, h2, n, n_docs, last_doc) of each key: its rows, its documents (the null doc_id is one) and the largest id. Rows of one key are merged within tasks and then by document, so a key in most documents is no large group."""
    by_doc = references.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _filter_of(h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
    room = max(1, h1.size)
    while not (c := Cuckoo.sized(room)).insert(h1, h2):
        room *= 2
    return c


_FILTER = "shard long, n_buckets long, slots binary"


def _shard(n_shards: int):
    return F.pmod(F.shiftrightunsigned("h1", 32), F.lit(n_shards)).cast("long")


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """A cuckoo filter per shard over the keys (h1, h2)."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        c = _filter_of(p["h1"].to_numpy().view(np.uint64), p["h2"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [key[0]], "n_buckets": [c.n], "slots": [c.table.tobytes()]})

    return keys.select(_shard(n_shards).alias("shard"), "h1", "h2").groupBy("shard").applyInPandas(build, _FILTER)


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, n_shards: int) -> DataFrame:
    """The filters after keys passed the threshold (added) or fell below it (removed). A shard that overflows raises: rebuild it from the counts."""
    changes = added.select(_shard(n_shards).alias("shard"), "h1", "h2", F.lit(1).alias("sign")).unionByName(removed.select(_shard(n_shards).alias("shard"), "h1", "h2", F.lit(-1).alias("sign")))

    def update(key: tuple, f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        h1, h2, sign = p["h1"].to_numpy().view(np.uint64), p["h2"].to_numpy().view(np.uint64), p["sign"].to_numpy()
        if f.empty:
            c = _filter_of(h1[sign > 0], h2[sign > 0])
        else:
            c = Cuckoo(int(f["n_buckets"].iloc[0]), np.frombuffer(f["slots"].iloc[0], np.uint16).reshape(-1, _SLOTS).copy())
            c.delete(h1[sign < 0], h2[sign < 0])
            if not c.insert(h1[sign > 0], h2[sign > 0]):
                raise ValueError(f"the filter of shard {key[0]} is full")
        return pd.DataFrame({"shard": [key[0]], "n_buckets": [c.n], "slots": [c.table.tobytes()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, _FILTER)


def probe(references: DataFrame, filters: DataFrame, n_shards: int, n_rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The references whose keys the filters know.

    References are routed by shard and dealt by rid to parts of some task_rows rows, each with a copy of the shard's
    filter, so neither a large shard nor a very common line makes a large task. In a task the
    rows are sorted so that a filter comes before its references, which then stream past it.
    """
    salts = max(1, -(-n_rows // (n_shards * task_rows)))
    salt = F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("long")
    kinds = [("shard", "long"), ("salt", "long"), ("kind", "int"), ("n_buckets", "long"), ("slots", "binary"), ("rid", "binary"), ("doc_id", "long"), ("h1", "long"), ("h2", "long")]

    def shaped(df: DataFrame, **have) -> DataFrame:
        return df.select(*[have.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds])

    copies = shaped(filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), kind=F.lit(0), h1=F.lit(0), h2=F.lit(0))
    every = copies.unionByName(shaped(references, shard=_shard(n_shards), salt=salt, kind=F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = None, None
        for b in batches:
            shard, dealt_to, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "kind"))
            heads = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(dealt_to) != 0)]) if len(shard) else []
            for at, stop in zip(heads, [*heads[1:], len(shard)], strict=True):
                if (key := (shard[at], dealt_to[at])) != own:
                    own, known = key, None
                if kind[at] == 0:
                    known = Cuckoo(b.column("n_buckets")[at].as_py(), np.frombuffer(b.column("slots")[at].as_py(), np.uint16).reshape(-1, _SLOTS))
                    at += 1
                if known is not None and at < stop:  # a shard without keys has no filter
                    part = b.slice(at, stop - at)
                    hit = known.contains(*(part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2")))
                    yield part.filter(pa.array(hit)).select(["rid", "doc_id", "h1", "h2"])

    dealt = every.repartition(max(1, n_shards * salts // TASK_COPIES), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInArrow(run, "rid binary, doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_rows: int = TASK_ROWS) -> DataFrame:
    """docs with the text that stays, and n_lines and n_dropped as __n_lines and __n_dropped.

    A key of at least min_chars code points found in at least min_docs documents loses all its lines except in the
    largest doc_id that holds it.
    """
    references = stored(line_references(docs, min_chars), "line-references")
    counts = stored(reference_counts(references), "line-counts").where(F.col("n_docs") >= min_docs)
    n_rows, n_keys = references.count(), counts.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    filters = stored(build_filters(counts, n_shards), "line-filters")
    known = probe(references, filters, n_shards, n_rows, task_rows)
    found = joined(known, counts.select("h1", "h2", "last_doc"), ["h1", "h2"], heavy(counts, "h1", "h2")).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    drops = found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("h1", "h2")).alias("__drops"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept, n, gone = [], [], []
            for t, d in zip(b["text"], b["__drops"], strict=True):
                lines = (t or "").encode().split(b"\n")
                if d is not None and len(d):
                    bad = {(x["h1"] & (1 << 64) - 1, x["h2"] & (1 << 64) - 1) for x in d}
                    stay = [x for x in lines if not _is_long(k := line_key(x), min_chars) or _hashes(k) not in bad]
                else:
                    stay = lines
                kept.append(t if len(stay) == len(lines) else b"\n".join(stay).decode())
                n.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield b.drop(columns=["__rid", "__drops"]).assign(text=kept, __n_lines=n, __n_dropped=gone)

    out = docs.withColumns({"__n_lines": F.lit(0).cast("long"), "__n_dropped": F.lit(0).cast("long")}).schema
    return docs.withColumn("__rid", row_key("doc_id", "text")).join(drops, "__rid", "left").mapInPandas(cut, out)
