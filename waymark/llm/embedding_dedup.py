"""Operator 7: near-duplicate embeddings by sorted projection passes.

Vectors that are equal in every component and label are one class. Each pass draws random hyperplanes, concatenates
the signs of a vector's projections to a hash, and sorts the classes by label and hash, lexicographically. A class is
compared with a bounded window of its neighbours in that order, and pairs verified over all passes are united.

* Hyperplanes go through the mean of the label's unit vectors, so that they split it evenly also where all vectors
  share a direction. plan() derives the number of passes from the data: at the threshold two vectors are
  2 (1 - threshold) apart, which against the label's spread about its mean gives the chance that a bit agrees, and so
  the chance that a pass brings a pair at the threshold within one window of the label. Passes grow as a small power
  of the largest label; there is no cap.
* Passes do not move the vectors. A pass sorts a code of one byte a component, with the length of what the code
  leaves out. That bounds the cosine from both sides: pairs that are surely linked are joined, sure non-links go, and
  what lies between is verified in double precision on the vectors themselves, fetched once for a pair. Passes go in
  rounds of ROUND, each a shuffle of its own of about twice the vectors' bytes, whose pairs are stored.
* A crowd of near vectors can be wider than a window, so an exact check follows: within each component all cosines are
  computed in blocks of bounded size (only counts leave a block), which gives every link between its members. Its time
  grows with the square of a crowd: that many links have to be counted.

Defined results: a null label, or a vector that is null, zero, or holds null or non-finite components, links with
nothing; vectors of different lengths never link; a null vec_id links like any other but names no component unless
it has no other; repeated rows are other vectors, and rows that share a vec_id but not label and vector are, too: each
has the links and the component of its own label and vector; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, row_key, stored
from ._components import components

THRESHOLD = 0.93
#: Neighbours that a class is compared with on either side, and the chance to miss a pair at the threshold.
WINDOW, MISS = 256, 0.01
#: Vectors of one block of the exact check, rows of one task of a pass, passes of one shuffle, and its tasks at most: a task streams its rows, so more of them take time, not memory.
BLOCK, TASK_ROWS, ROUND, MOST_TASKS = 1024, 40_000, 8, 20_000
SEED = 7


def agreement(spread: float, threshold: float) -> float:
    """The chance that the sign of a random projection about the mean agrees for two vectors at the threshold; spread is their label's mean square distance from its mean."""
    if spread <= 1 - threshold:
        return 0.5  # they are as far apart as strangers: nothing but the window separates them
    return 1 - float(np.arccos(1 - (1 - threshold) / spread)) / np.pi


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS, spread: float = 1.0) -> int:
    """Passes until a pair at the threshold has once shared the bits that lead to one window, with a chance of 1 - miss."""
    hit = agreement(spread, threshold) ** max(1.0, log2(max(n, 2) / window) + 1)
    return max(3, ceil(log(miss) / log(1 - min(hit, 0.999))))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with cid, the key of their class (null if invalid), and the classes (cid, low, size, label, v): low is the smallest vec_id."""
    v = F.col("embedding")
    valid = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    own = vectors.select("vec_id", "label", v.alias("v"), valid.alias("valid"))
    rows = own.select("vec_id", F.when(F.col("valid"), row_key("label", "v")).alias("cid"))
    found = own.where("valid").groupBy(row_key("label", "v").alias("cid")).agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    return rows, found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def means(found: DataFrame) -> DataFrame:
    """(label, dim, n, mean, spread): how many classes of each label and length, the mean of their unit vectors and the mean square distance from it. Summed within tasks first."""
    kind = dict(found.dtypes)["label"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for (label, dim), g in f.groupby(["label", f["v"].map(len)]):
                u = _unit(_matrix(g["v"]))
                rows.append((label, dim, len(g), u.sum(0)))
            yield pd.DataFrame(rows, columns=["label", "dim", "n", "sums"])

    each = found.select("label", "v").mapInPandas(run, f"label {kind}, dim long, n long, sums array<double>")
    at = each.select("label", "dim", "n", F.posexplode("sums").alias("i", "x"))
    counts = each.groupBy("label", "dim").agg(F.sum("n").alias("n"))
    sums = at.groupBy("label", "dim", "i").agg(F.sum("x").alias("x")).groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("sums"))
    mean = counts.join(sums, ["label", "dim"]).select("label", "dim", "n", F.transform("sums", lambda x: x / F.col("n")).alias("mean"))
    return mean.withColumn("spread", F.greatest(F.lit(0.0), 1 - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)))


def plan(found: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The table of means, and (dim, classes, passes) of each length of vectors: the passes that its most demanding label needs."""
    known = stored(means(found), "vector-means")
    # The most demanding label of each length and size class decides; a size class is a power of two, so few rows are collected.
    rows = known.groupBy("dim", F.floor(F.log2("n")).alias("step")).agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.min("spread").alias("spread")).collect()
    out = {}
    for r in rows:
        if r["n"] > 1:
            total, passes = out.get(r["dim"], (0, 0))
            out[r["dim"]] = (total + r["all"], max(passes, passes_for(r["n"], threshold, window, miss, r["spread"])))
    return known, [(d, *x) for d, x in sorted(out.items())]


def candidates(found: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b, sure) between class ids that were within a window of one another in some pass and may be linked."""
    known, dims = plan(found, threshold, window, miss)
    out = None
    for dim, total, passes in dims:
        own = found.where(F.size("v") == dim)
        of_dim = known.where(F.col("dim") == dim)
        centred = joined(own.select("label", "cid", "v"), of_dim.select("label", "mean"), ["label"], heavy(of_dim, "label"))
        for first in range(0, passes, ROUND):
            n = min(ROUND, passes - first)
            part = stored(_compared(centred, dim, first, n, threshold, window, seed, min(MOST_TASKS, max(1, total * n // task_rows))), "vector-pairs")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else found.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(True).alias("sure")).limit(0)


def _compared(centred: DataFrame, dim: int, first: int, passes: int, threshold: float, window: int, seed: int, n_parts: int) -> DataFrame:
    """A round of passes over the vectors of one length, from the number `first` on. Each pass is sorted by label and hash in range partitions; a pair across two partitions is left to the other passes."""
    planes = np.random.default_rng([seed, first]).standard_normal((dim, passes * 32)).astype(np.float32)
    kind = dict(centred.dtypes)["label"]

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u = _unit(_matrix(f["v"]))
            bits = np.packbits((u - _matrix(f["mean"])).astype(np.float32) @ planes > 0, axis=1).reshape(len(f), passes, 4).view(">u4")[:, :, 0].astype(np.int64)
            scale = np.abs(u).max(1) / 127
            code = np.rint(u / scale[:, None]).astype(np.int8)
            rest = np.sqrt(((u - code * scale[:, None]) ** 2).sum(1)) * 1.001 + 1e-9
            codes = [c.tobytes() for c in code]
            for k in range(passes):
                yield pd.DataFrame({"pass": k, "label": f["label"], "hash": bits[:, k], "cid": f["cid"], "code": codes, "scale": scale, "rest": rest.astype(np.float32)})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for f in frames:
            for i in range(0, len(f), 4 * window):
                g = f.iloc[i : i + 4 * window]
                old = 0 if left is None else len(left)
                g = g if left is None else pd.concat([left, g], ignore_index=True)
                yield _near(g, old, threshold, window)
                left = g.iloc[-window:]

    order = ["pass", "label", "hash", "cid"]
    every = centred.mapInPandas(hashes, f"pass int, label {kind}, hash long, cid binary, code binary, scale double, rest float")
    return every.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInPandas(compare, "a binary, b binary, sure boolean").distinct()


def _near(g: pd.DataFrame, old: int, threshold: float, window: int) -> pd.DataFrame:
    """Of sorted rows, the first `old` of which have met one another: stars of the pairs that are surely linked, and the pairs between their parts that may be."""
    n = len(g)
    x = np.frombuffer(b"".join(g["code"]), np.int8).reshape(n, -1).astype(np.float64) * g["scale"].to_numpy()[:, None]
    rest, size = g["rest"].to_numpy(np.float64), np.sqrt((x * x).sum(1))
    cosine = x @ x.T
    bound = size[:, None] * rest[None, :] + rest[:, None] * size[None, :] + rest[:, None] * rest[None, :] + 1e-9
    at = np.arange(n)
    own = pd.factorize(pd.MultiIndex.from_frame(g[["pass", "label"]]))[0]
    meet = (own[:, None] == own[None, :]) & (np.abs(at[:, None] - at[None, :]) <= window)
    sure = meet & (cosine - bound >= threshold)
    np.fill_diagonal(sure, True)
    root = at.copy()
    while True:
        low = np.where(sure, root[None, :], n).min(1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    ids = g["cid"].to_numpy()
    far = np.flatnonzero(root != at)
    i, j = np.nonzero(np.triu(meet & (cosine + bound >= threshold) & (root[:, None] != root[None, :]), 1))
    new = j >= old
    i, j = i[new], j[new]
    return pd.DataFrame({"a": np.r_[ids[far], ids[i]], "b": np.r_[ids[root[far]], ids[j]], "sure": np.r_[np.ones(far.size, bool), np.zeros(i.size, bool)]})


def verified(found: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) of class ids whose cosine, in double precision, is at least threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = _unit(_matrix(f["x"])), _unit(_matrix(f["y"]))
                yield f.loc[(x * y).sum(1) >= threshold, ["a", "b"]]

    x, y = found.select(F.col("cid").alias("a"), F.col("v").alias("x")), found.select(F.col("cid").alias("b"), F.col("v").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(run, "a binary, b binary")


def links(found: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b) between class ids: links that join what the passes found."""
    met = stored(candidates(found, threshold, window, miss, seed, task_rows), "vector-pairs")
    sure = met.where("sure").select("a", "b")
    doubtful = met.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return sure.unionByName(verified(found, doubtful, threshold))


def count_links(members: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """From (root, cid, size, v), and counts, its rows of each root: (cid, n), the vectors in other classes of the component that a class links with. Blocks of a large component meet in pairs."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sized = joined(members, counts.select("root", F.col("n").alias("count")), ["root"], heavy(counts, "root")).withColumn("k", F.ceil(F.col("count") / block))
    chunk = F.pmod(F.xxhash64("cid"), F.col("k"))
    small = sized.where("k = 1").select(F.lit(0).alias("x"), F.pmod(F.xxhash64("root"), F.lit(max(1, total // 4000))).alias("y"), F.lit(0).alias("chunk"), "root", "cid", "size", "v")
    large = sized.where("k > 1").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select((F.least("chunk", "other") + 1).alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "root", "cid", "size", "v")

    def count(f: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(f), np.int64)
        f = f.sort_values("root", kind="stable")
        root, size, side = f["root"].to_numpy(), f["size"].to_numpy(), f["chunk"].to_numpy()
        across = f["x"].iloc[0] not in (0, f["y"].iloc[0] + 1)  # two blocks: their inner pairs are counted elsewhere
        u = _unit(_matrix(f["v"]))
        ends = np.flatnonzero(np.r_[root[1:] != root[:-1], True]) + 1
        first = 0
        for end in ends:
            i = slice(first, end)
            a = u[i] @ u[i].T >= threshold
            np.fill_diagonal(a, False)
            if across:
                a &= side[i][:, None] != side[i][None, :]
            n[i], first = a @ size[i], end
        return pd.DataFrame({"cid": f["cid"].to_numpy(), "n": n})

    alike = [c.cast("long").alias(c_) for c, c_ in ((F.col("x"), "x"), (F.col("y"), "y"), (F.col("chunk"), "chunk"))]
    rows = small.select(*alike, "root", "cid", "size", "v").unionByName(large.select(*alike, "root", "cid", "size", "v"))
    # Components of one block share groups; a larger one has its own.
    own = F.when(F.col("x") == 0, F.lit(b"")).otherwise(F.col("root"))
    return rows.groupBy(own.alias("own"), "x", "y").applyInPandas(count, "cid binary, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    rows, found = classes(vectors)
    found = stored(found, "vector-classes")
    roots = stored(components(links(found, threshold, window, miss, task_rows=task_rows)).withColumnRenamed("node", "cid"), "vector-components")
    members = found.join(roots, "cid")
    counts = count_links(members.select("root", "cid", "size", "v"), stored(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "vector-roots"), threshold, block)
    of_class = found.select("cid", "low", "size").join(roots, "cid", "left").join(counts, "cid", "left").select("cid", "low", "size", F.coalesce("root", "cid").alias("root"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    of_class = stored(of_class, "vector-links")
    lows = stored(of_class.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")), "vector-lows")
    known = joined(of_class, lows.select("root", "component_id"), ["root"], heavy(lows, "root"))
    copies = heavy(of_class.select("cid", F.col("size").alias("n")), "cid")
    out = joined(rows.where("cid is not null"), known.select("cid", "n_links", "component_id"), ["cid"], copies).unionByName(rows.where("cid is null"), allowMissingColumns=True)
    component = F.coalesce("component_id", F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
