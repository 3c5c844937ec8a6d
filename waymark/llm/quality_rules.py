"""Operator 5: quality rules as robust multivariate outliers.

Each text's statistics are transformed to a vector: log mean word length, arcsine square roots of the shares of
symbols, of repeated lines, of words in repeated 3-word windows and of capitals, and log words a line. For each
language and source a minimum-covariance-determinant estimate is fitted to all its documents that pass the base rule.
It has several starts: medians and interquartile ranges, and the documents of STARTS - 1 random subsets, drawn by hash.
A concentration step keeps the SHARE of the group's documents of least Mahalanobis distance and takes their mean and
covariance; a start's steps go on until its determinant falls no more, and the start of least
determinant is the estimate (its covariance scaled to be consistent, plus FLOORS, the spread below which a difference
means nothing). A document is kept if its squared distance is at most CUT. Steps are joins and grouped sums over a
small table of statistics: no group is ever in one task, and quantiles come from sketches.

A group of fewer than LEAST documents is judged by the estimate of its language, then by that of all documents, each
fitted to all documents of its level, not only to those that are judged by it; with fewer than LEAST documents in all
there is no estimate and the base rule alone decides. `level` says which estimate judged a document.

Defined results: a null or empty text has no words and fails the base rule; a null lang or source is a value of its
own; a null doc_id stays null; repeated rows are judged alike; documents that tie at the SHARE's distance are all kept in
a step; a very long text is counted once, with memory in proportion to its length; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, released, stored, words

SHARE, STARTS, CUT, LEAST = 0.75, 4, 30.0, 60
#: A start ends when its log determinant falls by no more than this.
LEAST_FALL = 1e-3
#: Documents (expected) of a random subset, and the accuracy of quantile sketches.
SUBSET, ACCURACY = 30, 10_000
FLOORS = (0.05, 0.04, 0.15, 0.15, 0.05, 0.2)
#: SHARE / P(chi2 with 8 degrees <= the SHARE quantile of chi2 with 6 degrees).
CONSISTENT = 1.36
MIN_WORDS, MAX_REPEAT = 50, 50
_P = range(len(FLOORS))
_SPACES, _SYMBOLS, _CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))


def text_statistics(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals); n_lines counts lines with a word."""
    data, w = (text or "").encode(), words(text)
    n = len(w)
    if not n:
        return (0, 0, len(data) - len(data.translate(None, _SYMBOLS)), 0, 0, 0, 0)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, n)
    repeated = 0
    if n > 2:
        k = len(number)
        # Pairs are numbered anew, so that a triple's number is exact however many words there are.
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1] if k > 1 << 20 else ids[:-1] * k + ids[1:]
        triple = pair[:-1] * k + ids[2:]
        order = np.argsort(triple, kind="stable")
        same = triple[order][1:] == triple[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        cover = np.zeros(n, bool)
        for j in range(3):
            cover[j : n - 2 + j] |= twice
        repeated = int(cover.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    return (n, chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(data) - len(data.translate(None, _CAPITALS)))


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed and the vector x0, x1, ..."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = pd.DataFrame([text_statistics(t) for t in f["text"]], columns=list(_STATS))
            s.insert(0, "doc_id", f["doc_id"].astype("Int64").array)
            s.insert(1, "lang", f["lang"].to_numpy())
            s.insert(2, "source", f["source"].to_numpy())
            yield s

    s = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInPandas(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATS))
    n, lines, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def share(a: str, b: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))

    x = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols", chars), share("n_dup_lines", lines), share("n_repeat_words", n), share("n_capitals", chars), F.log(n / lines + 1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return s.withColumns({"base_failed": failed} | {f"x{i}": x[i] for i in _P})


def _grouped(s: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """s with g, the group by whose estimate a document is judged (null if all are too few), and gk2, gk1, gk0, its groups that are large enough; and the counted groups (g, n)."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    keyed = s.withColumns({"k1": lang, "k2": F.concat_ws("\x01", lang, source)})
    own = stored(keyed.groupBy("k1", "k2").agg(F.count_if(~F.col("base_failed")).alias("n2"), F.count(F.lit(1)).alias("n")), "statistics-sources")
    langs = own.groupBy("k1").agg(F.sum("n2").alias("n1"))
    total = own.agg(F.coalesce(F.sum("n2"), F.lit(0))).first()[0]
    name = lambda k, n: F.when(n >= least, F.concat(F.lit(f"{k}:"), F.col(k)))
    large = own.join(langs, "k1").select("k2", name("k2", F.col("n2")).alias("gk2"), name("k1", F.col("n1")).alias("gk1"), F.lit("all" if total >= least else None).cast("string").alias("gk0"))
    known = stored(large.withColumn("g", F.coalesce("gk2", "gk1", "gk0")), "statistics-levels")
    counts = own.select(F.concat(F.lit("k2:"), "k2").alias("g"), F.col("n2").alias("n")).unionByName(langs.select(F.concat(F.lit("k1:"), "k1").alias("g"), F.col("n1").alias("n"))).unionByName(own.agg(F.lit("all").alias("g"), F.sum("n2").alias("n")))
    return joined(keyed, known, ["k2"], heavy(own, "k2")), stored(counts.join(known.where("g is not null").select("g").distinct(), "g"), "statistics-groups")


def _members(grouped: DataFrame, used: DataFrame) -> DataFrame:
    """(g, h, x0, x1, ...): each document that passes the base rule, once in each of its groups by which some document is judged; h is a hash of its values."""
    x = [f"x{i}" for i in _P]
    every = grouped.where("not base_failed").select(F.explode(F.array_compact(F.array("gk2", "gk1", "gk0"))).alias("g"), F.xxhash64("doc_id", *x).alias("h"), *x)
    return joined(every, used.select("g"), ["g"], heavy(used, "g"))


_MEMBER = "g string, start int, fall double, logdet double, " + ", ".join([f"m{i} double" for i in _P] + [f"p{i}_{j} double" for i in _P for j in _P if j >= i])
_NAMES = [f.split()[0] for f in _MEMBER.split(", ")]


def _params(g, start: int, fall: float, mean: np.ndarray, cov: np.ndarray) -> list:
    """A row of the mean and the inverse covariance, off-diagonal terms doubled; logdet is that of the covariance."""
    cov = cov + np.diag(np.square(FLOORS))
    inv = np.linalg.inv(cov)
    return [g, start, fall, np.linalg.slogdet(cov)[1], *mean, *(inv[i, j] * (1 if i == j else 2) for i in _P for j in _P if j >= i)]


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in _P]
    return sum((d[i] * d[j] * F.col(f"p{i}_{j}") for i in _P for j in _P if j >= i), F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in _P], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in _P for j in _P if j >= i]]


def _fitted(scale: float):
    """From sums to parameters; `fall` is by how much the log determinant fell from `old`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in _P]) / r["n"]
                cov = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in _P] for i in _P]) / r["n"] - np.outer(mean, mean)
                row = _params(r["g"], r["start"], 0.0, mean, scale * cov)
                row[2] = r["old"] - row[3] if r["old"] is not None and np.isfinite(r["old"]) else np.inf
                rows.append(row)
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def estimate(members: DataFrame, counts: DataFrame, starts: int = STARTS, share: float = SHARE) -> DataFrame:
    """Per group g of members (g, h, x0, x1, ...): the robust mean and inverse covariance. counts has g and n, its members."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_params(g, 0, np.inf, np.array([x[1] for x in q]), np.diag([((x[2] - x[0]) / 1.349) ** 2 for x in q])) for g, *q in f.itertuples(index=False)], columns=_NAMES)

    middle = members.groupBy("g").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i in _P]).mapInPandas(first, _MEMBER)
    # A document is in the random subset of a start if its hash falls below the subset's share of the group.
    hot = heavy(counts, "g")
    sized = joined(members, counts, ["g"], hot)
    drawn = [F.when(F.pmod(F.xxhash64("h", F.lit(k)), F.lit(1 << 20)) * F.col("n") < F.lit((1 << 20) * SUBSET), F.lit(k)) for k in range(1, starts)]
    subset = sized.withColumn("start", F.explode(F.array_compact(F.array(F.lit(None).cast("int"), *drawn)))).drop("n")
    random = subset.groupBy("g", "start").agg(*_moments(), F.lit(None).cast("double").alias("old")).where(F.col("n") > 1).mapInPandas(_fitted(1.0), _MEMBER)
    going, ended = stored(middle.unionByName(random), "mcd").drop("fall"), []
    while not ended or going.head(1):
        far = joined(members, going, ["g"], hot).select("g", "start", *[f"x{i}" for i in _P], _distance().alias("d"))
        edges = stored(far.groupBy("g", "start").agg(F.percentile_approx("d", share, ACCURACY).alias("edge")), "mcd-edges")
        near = joined(members, going.join(edges, ["g", "start"]), ["g"], hot).withColumn("d", _distance()).where("d <= edge")
        sums = near.groupBy("g", "start").agg(*_moments(), F.first("logdet").alias("old"))
        params = stored(sums.mapInPandas(_fitted(CONSISTENT), _MEMBER), "mcd")
        released(edges)
        # A start whose determinant no longer falls has ended; its group's members meet the others alone.
        ended.append(params.where(F.col("fall") <= LEAST_FALL).drop("fall"))
        going = params.where(F.col("fall") > LEAST_FALL).drop("fall")
    params = reduce(DataFrame.unionByName, ended)
    best = params.groupBy("g").agg(F.min_by(F.struct(*[c for c in _NAMES if c not in ("g", "fall")]), F.struct("logdet", "start")).alias("p"))
    return best.select("g", "p.*").drop("start", "logdet")


def judge(docs: DataFrame, starts: int = STARTS, share: float = SHARE, cut: float = CUT, least: int = LEAST) -> DataFrame:
    """The statistics of each document, base_failed, level (k2, k1, all or null), distance (squared; null without an estimate) and kept."""
    grouped, counts = _grouped(stored(statistics(docs), "statistics"), least)
    grouped = stored(grouped, "statistics-grouped")
    members = stored(_members(grouped, counts), "statistics-members")
    params = stored(estimate(members, counts, starts, share=share), "mcd-best")
    released(members)
    judged = joined(grouped, params, ["g"], heavy(counts, "g"), "left")
    out = judged.withColumn("distance", _distance()).withColumn("level", F.split("g", ":")[0])
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cut))
    return out.withColumn("kept", kept).select("doc_id", *_STATS, "base_failed", "level", "distance", "kept")
