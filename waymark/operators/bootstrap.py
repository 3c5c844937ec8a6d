"""The bootstrap over subjects: replicates as arrays, so that rows are never repeated for each replicate.

Replicates come in blocks of BLOCK. Of a subject and a block one row lists the replicates that draw it, a byte each. Draws
are hashed in arrays, SPAN replicates and CHUNK draws a row of work, and leave it as counts by SHARD ranks, packed, so
what is shuffled of them is about a quarter of a byte a draw. Rows meet the lists by buckets of subjects: a bucket's counts
are a matrix (subject, replicate), its rows a sparse one (cell, subject) where a cell has a group's score and outcome, and
their product is what the bucket adds to the cells. So the rows move once, and what moves after them are cells. The rank
statistic of all replicates of a block then comes from one running sum down the scores, over ranges of scores and then
over the ranges. All statistics and groups of one call share the draws, so differences, contrasts and interactions of
them are those of a joint bootstrap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import evaluate
from .evaluate import ranged
from .quantiles import matched

#: Replicates of a block, fewer than a byte counts; replicates and draws of a row of work; ranks of a shard.
BLOCK, SPAN, CHUNK, SHARD = 250, 25, 1 << 16, 1 << 12
#: Subjects, rows and cells of a bucket at most, the buckets that there are at least, and the values of a matrix that is made at once.
SUBJECTS, ROWS, CELLS, LEAST, HELD = 1 << 13, 1 << 21, 1 << 16, 16, 1 << 22
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_word(words: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """The first 32 bits of MD5 of messages of one block, whose 16 words are numbers or arrays that fit the shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    # The last three of the 64 steps do not change the first word.
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word, turn = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16], _TURNS[kind][i % 4]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_SINES[i]), out=f), np.add(f, word, out=f)
        np.left_shift(f, np.uint32(turn), out=g), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def _digits(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(digits, from, to): the numbers from low to high - 1 by how many digits they have."""
    while low < high:
        n = len(str(low))
        yield n, low, min(high, 10**n)
        low = 10**n


def hashes(first: int, n: int, b: int, count: int) -> np.ndarray:
    """[replicate, draw]: the first 32 bits of md5(draw:replicate), of n draws and `count` replicates."""
    out = np.empty((count, n), np.uint32)
    for wide, low, high in _digits(first, first + n):
        for long, left, right in _digits(b, b + count):
            size = wide + 1 + long
            for lo in range(low, high, 1 << 14):
                i = np.arange(lo, min(high, lo + (1 << 14)), dtype=np.int64)
                step = max(1, (1 << 14) // i.size)
                for start in range(left, right, step):
                    r = np.arange(start, min(right, start + step), dtype=np.int64)[:, None]
                    words: list = [0] * 16
                    for at in range(size + 1):
                        if at < wide:
                            byte = (i // 10 ** (wide - 1 - at) % 10 + 48)[None].astype(np.uint32)
                        elif at == wide or at == size:
                            byte = ord(":") if at == wide else 0x80
                        else:
                            byte = (r // 10 ** (size - 1 - at) % 10 + 48).astype(np.uint32)
                        shifted = byte << 8 * (at % 4) if isinstance(byte, int) else byte << np.uint32(8 * (at % 4))
                        held = words[at // 4]
                        words[at // 4] = held + shifted if isinstance(held, int) == isinstance(shifted, int) else (np.uint32(held) + shifted if isinstance(held, int) else held + np.uint32(shifted))
                    words[14] = 8 * size
                    out[start - b : start - b + r.size, lo - first : lo - first + i.size] = _first_word(words, (r.size, i.size))
    return out


def _packed(m: np.ndarray) -> bytes:
    """Numbers as bytes; counts take as few as they need."""
    m = m.astype(np.min_scalar_type(int(m.max(initial=0)))) if m.dtype.kind in "iu" else m
    return m.dtype.char.encode() + pa.compress(np.ascontiguousarray(m).tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes, size: int) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    return np.frombuffer(pa.decompress(b[1:], size * kind.itemsize, "zstd", asbytes=True), kind)


def _by_shard(rank: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, [replicate, place]): how often each rank of a shard is drawn, from the ranks [replicate, draw] below size; shards without a draw are left out."""
    width, n = len(rank) * SHARD, -(-size // SHARD)
    code = ((rank // SHARD) * width + np.arange(len(rank))[:, None] * SHARD + rank % SHARD).ravel()
    if n * width <= 4 * code.size + width:
        yield from enumerate(np.bincount(code, minlength=n * width).reshape(n, len(rank), SHARD))
        return
    code.sort()
    ends = np.flatnonzero(np.r_[np.diff(code // width) > 0, True]) + 1
    for low, high in zip(np.r_[0, ends[:-1]], ends, strict=True):
        shard = int(code[low] // width)
        yield shard, np.bincount(code[low:high] - shard * width, minlength=width).reshape(len(rank), SHARD)


def draws(subjects: DataFrame, replicates: int, subject: str = "subject", mode: str = "multinomial", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, subject, block, picks): the replicates of each block, from 0, that draw the subject, a byte each, once for each time (mode membership: once at most). Each replicate draws as many subjects as there are (of the group, with by).

    Draw i of replicate b is the subject of rank floor(u * n), u from md5(i:b), so draws do not depend on partitions.
    """
    own = subjects.select(*by, subject).distinct().withColumn("__m", F.md5(F.col(subject).cast("string").cast("binary")))
    # Ranks follow the order of md5(subject), numbered by its first digits and then within them.
    own = own.withColumn("__c", F.substring("__m", 1, 3))
    counts = own.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("__n"))
    parts = Window.partitionBy(*by).orderBy("__c")
    starts = counts.select(*by, "__c", F.coalesce(F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__size"))
    place = F.row_number().over(Window.partitionBy(*by, "__c").orderBy("__m", subject)) - 1
    ranks = matched(own.withColumn("__i", place), starts, [*by, "__c"]).select(*by, subject, (F.col("__start") + F.col("__i")).cast("long").alias("__r"))
    keys = [*by, "__shard"]
    kept = [sizes.schema[k] for k in by]
    work = sizes.where("__size > 0").withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__size") - 1, F.lit(CHUNK).cast("long"))))
    spans = F.array(*[F.lit(b) for b in range(0, replicates, SPAN)])
    work = work.withColumn("__b", F.explode(spans)).repartition(max(1, -(-replicates // SPAN)))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                size, first, b = (batch[c][at].as_py() for c in ("__size", "__first", "__b"))
                n, end = min(CHUNK, size - first), min(b + SPAN, replicates)
                step, out = max(1, (1 << 18) // n), []
                for low in range(b, end, step):
                    count = min(step, end - low)
                    rank = (hashes(first, n, low, count).astype(np.uint64) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
                    out += [(shard, low // BLOCK, low % BLOCK, count, _packed(c)) for shard, c in _by_shard(rank, size)]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch[k].take(pa.array([at] * len(out))) for k in by], *columns], names=[*by, "__shard", "block", "__at", "__count", "__held"])

    counted = work.mapInArrow(drawn, T.StructType([*kept, *[T.StructField(n, k) for n, k in (("__shard", T.LongType()), ("block", T.IntegerType()), ("__at", T.IntegerType()), ("__count", T.IntegerType()), ("__held", T.BinaryType()))]]))

    def listed(own: pa.Table, held: pa.Table) -> pa.Table:
        place, block = own["__r"].to_numpy() % SHARD, held["block"].to_numpy()
        found = []
        for j in np.unique(block):
            m = np.zeros((BLOCK, SHARD), np.int64)
            for x in held.filter(pa.array(block == j)).select(["__at", "__count", "__held"]).to_pylist():
                m[x["__at"] : x["__at"] + x["__count"]] += _unpacked(x["__held"], x["__count"] * SHARD).reshape(-1, SHARD)
            m = m.T[place] if mode == "multinomial" else m.T[place] > 0
            at, b = np.nonzero(m)
            times = m[at, b].astype(np.int64)
            sizes = np.bincount(at, times, place.size).astype(np.int64)
            drawn = np.flatnonzero(sizes)
            ends = np.r_[0, np.cumsum(sizes[drawn])].astype(np.int32)
            picks = pa.Array.from_buffers(pa.binary(), drawn.size, [None, pa.py_buffer(ends), pa.py_buffer(np.repeat(b, times).astype(np.uint8))])
            rows = own.select([*by, subject]).take(pa.array(drawn))
            found.append(rows.append_column("block", pa.array(np.full(drawn.size, j, np.int32))).append_column("picks", picks))
        none = own.select([*by, subject]).slice(0, 0).append_column("block", pa.array([], pa.int32())).append_column("picks", pa.array([], pa.binary()))
        return pa.concat_tables(found or [none])

    schema = T.StructType([*kept, ranks.schema[subject], T.StructField("block", T.IntegerType()), T.StructField("picks", T.BinaryType())])
    placed = ranks.withColumn("__shard", F.expr(f"__r div {SHARD}"))
    return placed.groupBy(*keys).cogroup(counted.groupBy(*keys)).applyInArrow(listed, schema)


def _rows(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, BLOCK, dtype=np.int32)), pa.array(m.ravel()))


def _groups(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) of rows that are equal in these columns, nulls included."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        _, codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return first, codes


def _product(counts: np.ndarray, subject: np.ndarray, cell: np.ndarray, weight: np.ndarray, n: int, kind: type) -> np.ndarray:
    """[cell, replicate]: the summed weights of n cells, of rows with a subject, a cell and a weight, from the counts [subject, replicate]."""
    out = np.zeros((n, counts.shape[1]), kind)
    if n * len(counts) < 45 * cell.size:
        sparse = np.bincount(cell * len(counts) + subject, weight, n * len(counts)).reshape(n, -1).astype(kind)
        for low in range(0, len(counts), 2048):
            out += sparse[:, low : low + 2048] @ counts[low : low + 2048].astype(kind)
        return out
    # Few rows a cell: the first of each cell, then the second of each, and so on.
    order = np.argsort(cell, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
    turn = np.arange(order.size) - np.repeat(heads, np.diff(np.r_[heads, order.size]))
    order = order[np.argsort(turn, kind="stable")]
    ends = np.cumsum(np.bincount(turn))
    for low, high in zip(np.r_[0, ends[:-1]], ends, strict=True):
        own = order[low:high]
        out[cell[own]] += counts[subject[own]] * weight[own, None].astype(kind)
    return out


def _counts(lists: pa.Table, subject: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, [subject, replicate]): how often each replicate of the blocks draws each of n subjects; subject numbers those of the lists."""
    block = lists["block"].to_numpy()
    blocks, top = np.unique(block), 0
    found = []
    for j in blocks:
        own = np.flatnonzero(block == j)
        picks = lists["picks"].take(pa.array(own)).cast(pa.large_binary()).combine_chunks()
        picks = picks.chunk(0) if isinstance(picks, pa.ChunkedArray) else picks
        ends = np.frombuffer(picks.buffers()[1], np.int64)[picks.offset : picks.offset + len(picks) + 1]
        flat = np.frombuffer(picks.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        m = np.bincount(np.repeat(subject[own] * BLOCK, np.diff(ends)) + flat, minlength=n * BLOCK)
        top = max(top, int(m.max(initial=0)))
        found.append(m.astype(np.min_scalar_type(int(m.max(initial=0)))).reshape(n, BLOCK))
    return blocks, np.hstack(found).astype(np.min_scalar_type(top))


def _summed(rows: DataFrame, drawn: DataFrame, on: list[str], keys: list[str], weights: dict[str, Column], cells: dict[str, list[str]], stat: str | None = None, many: bool = False) -> DataFrame:
    """(keys, block, cells, one column a weight): of each key and block the cells that its rows have, as packed columns, and the weights of each cell's rows, packed, summed for each replicate that draws their subject (on). A key and block has several rows, which add up.

    cells: for each value of the column `stat` the columns that make its cells, numbers without nulls; with stat None there is one. many: whether cells are about as many as rows.
    """
    names, summed = list(dict.fromkeys([*on, *keys])), list(weights)
    inner = list(dict.fromkeys(c for own in cells.values() for c in own))
    held = rows.select(*names, *inner, *[c.alias(f"__w_{w}") for w, c in weights.items()])
    key = F.xxhash64(*on)
    n, total = rows.select(*on).agg(F.approx_count_distinct(key), F.count(F.lit(1))).first()
    buckets = max(-(-n // SUBJECTS), -(-total // ROWS), -(-total * len(cells) // CELLS) if many else 0, LEAST)
    dealt = lambda df: df.withColumn("__bucket", F.pmod(key, F.lit(buckets)).cast("int"))
    made = [f"__c{i}" for i in range(max(map(len, cells.values())))]
    fields = [*[held.schema[k] for k in keys], *([T.StructField(stat, T.StringType())] if stat else []), T.StructField("block", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in (*made, *weights)]]

    def run(own: pa.Table, lists: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and lists.num_rows:
            both = [pa.chunked_array([*lists[c].chunks, *own[c].chunks]).combine_chunks() for c in on]
            code = _groups(both)[1]
            size = int(code.max()) + 1
            blocks, counts = _counts(lists, code[: lists.num_rows], size)
            subject, most = code[lists.num_rows :], int(counts.max(initial=0))
            columns = {c: own[c].combine_chunks() for c in [*keys, *inner]}
            kfirst, kcode = _groups([columns[k] for k in keys]) if keys else (np.zeros(1, np.int64), np.zeros(own.num_rows, np.int64))
            weight = {w: own[f"__w_{w}"].to_numpy() for w in summed}
            # Sums of counts are exact in 32 bits as far as they stay below 2 ** 24.
            kind = {w: np.float32 if x.dtype.kind in "iu" and int(np.abs(x).sum()) * most < 1 << 24 else np.float64 for w, x in weight.items()}
            wide = max(1, min(2048, HELD // size))
            for name, parts in cells.items():
                first, cell = _groups([pa.array(kcode), *[columns[c] for c in parts]])
                order = np.argsort(cell, kind="stable")
                sorted_cell = cell[order]
                of_key = kcode[first]
                for low in range(0, first.size, wide):
                    high = min(low + wide, first.size)
                    some = order[np.searchsorted(sorted_cell, low) : np.searchsorted(sorted_cell, high)]
                    sums = {w: _product(counts, subject[some], cell[some] - low, weight[w][some], high - low, kind[w]) for w in summed}
                    sums = {w: m.astype(np.int64) if weight[w].dtype.kind in "iu" else m for w, m in sums.items()}
                    edges = np.flatnonzero(np.r_[True, np.diff(of_key[low:high]) != 0, True])
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        at = first[low + a : low + b]
                        values = [columns[c].take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float).tobytes() for c in parts]
                        for j, block in enumerate(blocks):
                            out.append((kfirst[of_key[low + a]], name, int(block), *values, *[_packed(m[a:b, j * BLOCK : (j + 1) * BLOCK]) for m in sums.values()]))
        at, name, block, *rest = zip(*out, strict=True) if out else [[] for _ in range(3 + len(made) + len(summed))]
        data = [*[own[k].take(pa.array(at, pa.int64())) for k in keys], *([pa.array(name, pa.string())] if stat else []), pa.array(block, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]]
        return pa.table(data, names=[f.name for f in fields])

    return dealt(held).groupBy("__bucket").cogroup(dealt(drawn).groupBy("__bucket")).applyInArrow(run, T.StructType(fields))


def _cells(t: pa.Table, columns: int, weights: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The cells' columns, and the sums [cell, replicate] of each weight, of all rows of a key and block."""
    values = [[np.frombuffer(b, float) for b in t[f"__c{i}"].to_pylist()] for i in range(columns)]
    sizes = [x.size for x in values[0]] if columns else [1] * t.num_rows
    sums = [np.concatenate([_unpacked(b, n * BLOCK).reshape(n, BLOCK).astype(float) for b, n in zip(t[w].to_pylist(), sizes, strict=True)]) for w in weights]
    return [np.concatenate(v) for v in values], sums


def _each(blocks: DataFrame, by: list[str], names: list[str], replicates: int) -> DataFrame:
    """One row a replicate of arrays a block; NaN is null."""
    out = blocks.select(*by, "block", F.posexplode(F.arrays_zip(*names)).alias("i", "x")).select(*by, (F.col("block") * BLOCK + F.col("i")).alias("b"), *[F.nanvl(f"x.{n}", F.lit(None).cast("double")).alias(n) for n in names])
    return out.where(F.col("b") < replicates)


def _arrays(t: pa.Table, name: str) -> np.ndarray:
    c = t[name].combine_chunks()
    return c.flatten().to_numpy().reshape(len(c), BLOCK)


def aurocs(rows: DataFrame, by: list[str], drawn: DataFrame, replicates: int, subject: str = "subject", score: str | dict[str, str] = "score", y: str = "y", own_draws: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, auroc): the AUROC of each group of rows in each replicate, null with one class only. own_draws: the columns among by whose groups draw for themselves, as in draws(by=...). With several scores (name: column) the column `stat`, the last of by, names the score."""
    several = isinstance(score, dict)
    scores = score if several else {"": score}
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    base = rows.select(*dict.fromkeys([*own_draws, subject, *by]), F.coalesce(F.col(y).cast("int"), F.lit(2)).alias("__y"), *[value(c).alias(f"__score_{i}") for i, c in enumerate(scores.values())])
    listed = F.array(*[F.struct(F.lit(n).alias("__stat"), F.col(f"__score_{i}").alias("__score")) for i, n in enumerate(scores)])
    apart = lambda df: df.withColumn("__s", F.explode(listed)).select(*[c for c in df.columns if not c.startswith("__score_")], "__s.*")
    every = [*by, "__stat"]
    # A range is needed only where a group has many scores.
    distinct = apart(base.select(*by, *[f"__score_{i}" for i in range(len(scores))])).groupBy(*every, "__score").agg(F.lit(1))
    most, total = distinct.groupBy(*every).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    on, weights = [*own_draws, subject], {"__n": F.lit(1)}
    if most <= evaluate.FEW:
        cells = {n: ["__y", f"__score_{i}"] for i, n in enumerate(scores)}
        summed = _summed(base, drawn, on, by, weights, cells, "__stat", many=total > CELLS).withColumn("__range", F.lit(0))
    else:
        summed = _summed(ranged(apart(base), every, "__score"), drawn, on, [*every, "__range"], weights, {"": ["__y", "__score"]}, many=total > CELLS)
    keys = [*every, "block", "__range"]
    summed = summed.select(*keys, "__c0", "__c1", "__n")
    kinds = {f.name: f for f in summed.schema}
    array = lambda n: T.StructField(n, T.ArrayType(T.DoubleType()))

    def sums(t: pa.Table) -> pa.Table:
        (positive, s), (w,) = _cells(t, 2, ["__n"])
        values, at = np.unique(s, return_inverse=True)
        both = np.zeros((2, values.size, BLOCK))
        for k in (0, 1):
            own = np.flatnonzero(positive == k)
            own = own[np.argsort(at[own], kind="stable")]
            if own.size:
                head = np.flatnonzero(np.r_[True, np.diff(at[own]) > 0])
                both[k][at[own][head]] = np.add.reduceat(w[own], head, axis=0)
        low = np.cumsum(both[0], 0) - both[0] / 2
        parts = [(both[1] * low).sum(0), both[1].sum(0), both[0].sum(0)]
        return pa.table([*[t[k].combine_chunks()[:1] for k in keys], *[_rows(x[None]) for x in parts]], names=[*keys, "u", "up", "down"])

    ranges = summed.groupBy(*keys).applyInArrow(sums, T.StructType([*[kinds[k] for k in keys], *map(array, ("u", "up", "down"))]))

    def totals(t: pa.Table) -> pa.Table:
        order = np.argsort(t["__range"].to_numpy())
        u, up, down = (_arrays(t, n)[order] for n in ("u", "up", "down"))
        pairs = up.sum(0) * down.sum(0)
        total = (u + up * (np.cumsum(down, 0) - down)).sum(0)
        value = np.divide(total, pairs, out=np.full(BLOCK, np.nan), where=pairs > 0)
        return pa.table([*[t[k].combine_chunks()[:1] for k in [*every, "block"]], _rows(value[None])], names=[*every, "block", "auroc"])

    blocks = ranges.groupBy(*every, "block").applyInArrow(totals, T.StructType([*[kinds[k] for k in [*every, "block"]], array("auroc")]))
    return _each(blocks.withColumnRenamed("__stat", "stat"), [*by, "stat"] if several else by, ["auroc"], replicates)


def iaurocs(rows: DataFrame, by: list[str], drawn: DataFrame, replicates: int, n_landmarks: int, subject: str = "subject", score: str | dict[str, str] = "score", y: str = "y", own_draws: tuple[str, ...] = ()) -> DataFrame:
    """(by, b, iauroc): in each replicate the mean AUROC over landmarks k, null unless all can be estimated; with several scores also `stat`, as in aurocs()."""
    per = aurocs(rows, [*by, "k"], drawn, replicates, subject, score, y, own_draws)
    every = [*by, *(["stat"] if isinstance(score, dict) else [])]
    g = per.groupBy(*every, "b").agg(F.avg("auroc").alias("mean"), F.count("auroc").alias("n"))
    return g.select(*every, "b", F.when(F.col("n") == n_landmarks, F.col("mean")).alias("iauroc"))


def stacked(rows: DataFrame, scores: dict[str, str]) -> DataFrame:
    """rows once for each score column, with `stat` its name and `score` its value."""
    values = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(c).cast("double").alias("score")) for n, c in scores.items()])
    held = set(scores.values()) | {"score", "stat"}
    return rows.select(*[c for c in rows.columns if c not in held], F.explode(values).alias("__s")).select("*", "__s.*").drop("__s")


def side_by_side(replicates: DataFrame, by: list[str], name: str, names: list[str], value: str) -> DataFrame:
    """(by, one column for each name): a replicate's statistics in one row."""
    return replicates.groupBy(*by).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def net_benefits(rows: DataFrame, scores: list[str], thresholds: list[float], drawn: DataFrame, replicates: int, subject: str = "subject") -> DataFrame:
    """(pt, b, one column per score): the net benefit of each replicate; a subject's rows are summed per threshold before they meet the draws."""
    t = rows.withColumn("pt", F.explode(F.array(*map(F.lit, thresholds))))
    sums = [F.sum(F.when(F.col(s) >= F.col("pt"), F.when(F.col("y") == 1, 1.0).otherwise(-F.col("pt") / (1 - F.col("pt")))).otherwise(0.0)).alias(s) for s in scores]
    per = t.groupBy(subject, "pt").agg(F.count(F.lit(1)).alias("__n"), *sums)
    names = [*scores, "__n"]
    summed = _summed(per, drawn, [subject], ["pt"], {n: F.col(n) for n in names}, {"": []})

    def added(t: pa.Table) -> pa.Table:
        return pa.table([*[t[k].combine_chunks()[:1] for k in ("pt", "block")], *[_rows(m.sum(0)[None]) for m in _cells(t, 0, names)[1]]], names=["pt", "block", *names])

    blocks = summed.groupBy("pt", "block").applyInArrow(added, T.StructType([summed.schema["pt"], summed.schema["block"], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]]))
    return _each(blocks, ["pt"], names, replicates).select("pt", "b", *[F.try_divide(s, "__n").alias(s) for s in scores])


def incidences(rows: DataFrame, by: list[str], drawn: DataFrame, replicates: int, cause: int, horizon: int | Sequence[int], predicted: str, time: str = "bin", event: str = "cause", subject: str = "subject") -> DataFrame:
    """(by, b, predicted, observed): in each replicate the mean of a predicted incidence and the Kaplan-Meier incidence of the cause by the horizon, other causes censored; null in a replicate without rows. With several horizons one row for each, in the column `horizon`, from one pass."""
    several = not isinstance(horizon, int)
    horizons, keys = list(horizon) if several else [horizon], [*by, "block"]
    # A time that is not known is later than any other.
    cells = rows.select(*dict.fromkeys([subject, *by]), F.coalesce(F.col(time).cast("double"), F.lit(float("inf"))).alias("__t"), F.coalesce((F.col(event) == cause).cast("int"), F.lit(0)).alias("__d"), F.coalesce(F.col(predicted).cast("double"), F.lit(0.0)).alias("__p"))
    summed = _summed(cells, drawn, [subject], by, {"__n": F.lit(1), "__d": F.col("__d"), "__p": F.col("__p")}, {"": ["__t"]})
    kinds = {f.name: f for f in summed.schema}
    made = ["horizon", "predicted", "observed"]

    def curves(t: pa.Table) -> pa.Table:
        (s,), sums = _cells(t, 1, ["__n", "__d", "__p"])
        times, at = np.unique(s, return_inverse=True)
        n, d, p = np.zeros((3, times.size, BLOCK))
        for held, m in zip((n, d, p), sums, strict=True):
            np.add.at(held, at, m)
        # At risk at a time are those of that time and of later ones.
        risk = np.cumsum(n[::-1], 0)[::-1]
        some = risk[0] > 0
        mean = np.divide(p.sum(0), risk[0], out=np.full(BLOCK, np.nan), where=some)
        step = 1 - np.divide(d, risk, out=np.zeros_like(d), where=risk > 0)
        left = [np.where((times <= h)[:, None] & (risk > 0), step, 1.0).prod(0) for h in horizons]
        first = [pa.concat_arrays([t[k].combine_chunks()[:1]] * len(horizons)) for k in keys]
        return pa.table([*first, pa.array(horizons, pa.int32()), _rows(np.vstack([mean] * len(horizons))), _rows(np.vstack([np.where(some, 1 - x, np.nan) for x in left]))], names=[*keys, *made])

    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("predicted", "observed")]
    blocks = summed.groupBy(*keys).applyInArrow(curves, T.StructType([*[kinds[k] for k in keys], T.StructField("horizon", T.IntegerType()), *arrays]))
    return _each(blocks, [*by, "horizon"] if several else by, ["predicted", "observed"], replicates)
