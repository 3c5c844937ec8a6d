"""Operator 6: SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits. Two of them that differ in at most `bits` bits, their bits being split into m partitions,
differ in at most t_i bits within some partition i, whenever the thresholds t_i (-1 leaves a partition out) sum to
bits - m + 1. Correlated bits go into one partition, so partitions differ in how selective they are. For each of some
splits into m partitions, of equal and unequal widths, a dynamic programme allocates the thresholds of least cost:
estimated candidates plus probes, from the counted matches of each partition and the counted balance of each bit; the
cheapest split is used. As fingerprints grow in number, the values of narrow partitions become crowded and their
counted cost rises, so wider partitions with larger thresholds take over. Distinct fingerprints (copies are one row)
are indexed by the value of each partition in use, probed with all values within its threshold, and verified bit by bit.

A partition's value that more than LIMIT distinct fingerprints share would make too many candidates. The fingerprints
that probe it meet in the middle instead: each emits the 65 codes within one flipped bit; two fingerprints that
differ in at most two bits have such a code in common, and a code's fingerprints are linked to the least of them
(for more than two bits, the flips of a code number more). The programme prices these flips as what they are, so they
are left for the few values that are hot under every split. Links become components by stars; nothing is collected.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a null doc_id joins its
component but is never its id, unless the component has no other; repeated rows share a component; a very long text is
hashed in blocks; columns of docs pass through keep_one, names that begin with __ are this operator's (__rid); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, row_key, stored, temporary, words
from ._components import components

SHINGLE, BITS, SEED = 3, 2, 42
#: Distinct fingerprints that may share a partition's value before they meet in the middle.
LIMIT = 256
#: Cost of a probe in candidates.
PROBE = 8.0
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, A-Z lower-cased, repeats included; of the whole sequence if it is shorter."""
    w = words(text)
    w = b" ".join(w).lower().split()
    parts = zip(*[w[i:] for i in range(size)], strict=False) if len(w) >= size else ([w] if w else [])
    h = xxhash.xxh64_intdigest
    return np.array([h(b" ".join(p), seed) for p in parts], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingle hashes."""
    h = shingle_hashes(text, size, seed).astype(">u8")
    if not h.size:
        return 0
    ones = sum(np.unpackbits(h[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for i in range(0, h.size, _BLOCK))
    return int.from_bytes(np.packbits(2 * ones > h.size).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(rid, doc_id, code): the fingerprint of each whole text as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            code = np.array([fingerprint(t, size, seed) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"rid": f["rid"], "doc_id": f["doc_id"].astype("Int64"), "code": code})

    return docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long"), "text").mapInPandas(run, "rid binary, doc_id long, code long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_sums(codes: DataFrame) -> tuple[int, np.ndarray]:
    """How many codes there are and how often bits i and j are both 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((64, 64))
        for f in frames:
            b = np.unpackbits(f["code"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(b), both + b.T.astype(np.float64) @ b
        yield pd.DataFrame(np.c_[np.arange(64), np.full(64, n), both], columns=["i", "n", *[f"c{j}" for j in range(64)]])

    got = codes.select("code").mapInPandas(run, "i double, n double, " + ", ".join(f"c{j} double" for j in range(64))).groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(f"c{j}").alias(f"c{j}") for j in range(64)]).orderBy("i").collect()
    return (int(got[0]["n"]), np.array([r[2:] for r in got])) if got else (0, np.zeros((64, 64)))


def splits(bits: int) -> list[list[int]]:
    """Widths of partitions that are tried: for each number of them equal ones, and a first one that is narrower than the rest."""
    out = [[64]]
    for m in range(2, bits + 2):
        out.append([64 * (k + 1) // m - 64 * k // m for k in range(m)])
        first = 64 * 3 // (4 * m)
        out.append([first, *[(64 - first) * (k + 1) // (m - 1) - (64 - first) * k // (m - 1) for k in range(m - 1)]])
    return out


def partitions(n: int, both: np.ndarray, widths: list[int]) -> list[list[int]]:
    """64 bits in partitions of these widths, the most correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = set(range(64)), []
    for width in widths:
        rest = sorted(left)
        pair = max(combinations(rest, 2), key=lambda x: r[x]) if width > 1 else (rest[0],)
        part = list(pair)
        while len(part) < width:
            part.append(max((b for b in rest if b not in part), key=lambda b: r[b, part].sum()))
        left -= set(part)
        out.append(sorted(part))
    return out


def allocate(cost: list[list[float]], bits: int) -> tuple[float, list[int]]:
    """cost[i][t + 1]: of threshold t in partition i, t = -1 first. The thresholds of least total cost that sum to bits - m + 1."""
    m = len(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (paid, chosen) in best.items():
            for k, x in enumerate(c):
                if total + k <= bits + 1 and (total + k not in now or paid + x < now[total + k][0]):
                    now[total + k] = (paid + x, [*chosen, k - 1])
        best = now
    return best[bits + 1]


def _mask(part: list[int]) -> int:
    return _signed(reduce(lambda a, b: a | 1 << b, part, 0))


def plan(codes: DataFrame, bits: int, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """The partitions in use, each with its threshold."""
    n, both = _bit_sums(codes)
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) ** 2, 1e-6)
    tried = [partitions(n, both, widths) for widths in splits(bits)]
    parts = [x for t in tried for x in t]
    # Of each partition: the candidates in values that pair, and the fingerprints in crowded ones, which emit all flips of a middle.
    each = codes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("code").bitwiseAND(_mask(x)).alias("v")) for i, x in enumerate(parts)])).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    few = F.col("c") <= limit
    counted = {r["i"]: (r["pairs"] or 0.0, r["crowd"] or 0.0) for r in each.groupBy("i").agg(F.sum(F.when(few, F.col("c") * F.col("c"))).alias("pairs"), F.sum(F.when(~few, F.col("c"))).alias("crowd")).collect()}
    middles = sum(comb(64, k) for k in range(bits - bits // 2 + 1))
    best, at = None, 0
    for t_parts in tried:
        cost = []
        for i, x in enumerate(t_parts, at):
            (pairs, crowd), c, odds = counted.get(i, (0.0, 0.0)), [0.0], (1 - agree[x]) / agree[x]
            sums = [1.0, *[0.0] * (bits + 1)]  # of products of the odds of 1, 2, ... bits that differ
            for o in odds:
                for t in range(bits + 1, 0, -1):
                    sums[t] += sums[t - 1] * o
            for t in range(min(bits, len(x)) + 1):
                reached = min(float(n), crowd * sum(sums[: t + 1]))
                c.append(pairs * sum(sums[: t + 1]) + PROBE * n * sum(comb(len(x), k) for k in range(t + 1)) + PROBE * middles * reached)
            cost.append(c)
        at += len(t_parts)
        total, chosen = allocate(cost, bits)
        if best is None or total < best[0]:
            best = (total, [(x, t) for x, t in zip(t_parts, chosen, strict=True) if t >= 0])
    return best[1]


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(reduce(lambda a, b: a | 1 << b, x, 0)) for k in range(most + 1) for x in combinations(bits, k)]


def _within(code: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: code.bitwiseXOR(m))


def _probes(own: Column, i: int, masks: list[int]) -> Column:
    return F.transform(_within(own, masks), lambda v: F.struct(F.lit(i).alias("i"), v.alias("v")))


def links(codes: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """(a, b): links of at most `bits` bits between distinct codes, enough of them to join all that are linked."""
    chosen = plan(codes, bits, limit)
    index, probes = [], []
    for i, (part, t) in enumerate(chosen):
        own = F.col("code").bitwiseAND(_mask(part))
        index.append(F.array(F.struct(F.lit(i).alias("i"), own.alias("v"))))
        probes.append(_probes(own, i, _flips(part, t)))
    indexed = codes.select("code", F.explode(F.concat(*index)).alias("x")).select("code", "x.i", "x.v")
    probing = codes.select(F.col("code").alias("from"), F.explode(F.concat(*probes)).alias("x")).select("from", "x.i", "x.v") if any(t for _, t in chosen) else indexed.withColumnRenamed("code", "from")
    shared = stored(indexed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1" if not any(t for _, t in chosen) else "n > 0"), "simhash-values")
    flipped = any(t for _, t in chosen)
    asked = stored(probing.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), "simhash-probes") if flipped else shared
    # Values that very many codes have, or ask for, are split wherever rows meet by value.
    held = joined(indexed, shared, ["i", "v"], heavy(shared, "i", "v"))
    asking = joined(probing, shared, ["i", "v"], heavy(asked, "i", "v"))
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("from"))) <= bits
    few = F.col("n") <= limit
    found = held.where(few).drop("n").join(asking.where(few).drop("n"), ["i", "v"]).where((F.col("code") != F.col("from") if flipped else F.col("code") < F.col("from")) & near).select(F.col("code").alias("a"), F.col("from").alias("b"))
    crowd = stored(asking.where(~few).select(F.col("from").alias("code")).distinct(), "simhash-crowd")
    half = bits - bits // 2
    meet = crowd.select("code", F.explode(_within(F.col("code"), _flips([*range(64)], half))).alias("z"))
    least = meet.groupBy("z").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low < high").select("z", "low")
    # For even bits all codes around a middle are within 2 * half = bits of one another; for odd bits pairs are checked.
    star = meet.join(least, "z").where("code <> low").select(F.col("low").alias("a"), F.col("code").alias("b")).distinct()
    if bits % 2:
        other = meet.select(F.col("code").alias("b"), "z")
        star = meet.select(F.col("code").alias("a"), "z").join(other, "z").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()
    return found.unionByName(star)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """(code, rid, doc_id, root, component): root names the component; component is the smallest doc_id in it, null if it has none."""
    prints = stored(fingerprints(docs, size, seed), "simhash")
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-codes")
    roots = components(links(codes, bits, limit))
    of_code = stored(codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select("code", "low", F.coalesce("root", "code").alias("root")), "simhash-roots")
    lows = stored(of_code.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n")), "simhash-lows")
    named = joined(of_code, lows.select("root", "component"), ["root"], heavy(lows, "root"))
    return joined(prints, named.select("code", "root", "component"), ["code"], heavy(codes.select("code", "n"), "code"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id stays (of rows without ids, one)."""
    with temporary():
        return first_rows(docs, near_duplicates(docs, **options))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each root in found (root, rid, doc_id) the row of the smallest doc_id. Rows are chosen as they come, so of rows that repeat one stays."""
    first = stored(found, "first-rows", keep=True).groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("__rid"))
    keyed = docs.withColumn("__rid", row_key("doc_id", "text"))
    return keyed.join(first.select("__rid").distinct(), "__rid", "left_semi").dropDuplicates(["__rid"]).drop("__rid")
