"""Operator 3: a quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes two blocks of hashed terms: its lower-cased words, and its style (shapes of words such as Aa, A! or
a*, shares of words that repeat in place, in 3-word windows or as lines, classes of text and line length). The model is
fitted on at most SAMPLE labelled rows, those of least hash, so that the choice follows from the rows alone: their
inverse document frequencies weigh the terms, and a singular value decomposition gives RANK latent directions. The
labelled latent vectors, bounded by SAMPLE * RANK numbers, are broadcast; every document's exact cosine products
with all of them are computed block by block, and its NEIGHBOURS nearest labels vote with weights cosine ** POWER.

Defined results: null and empty texts share one vector without words and get a score like any other; rows without a
usable label (null, or not 0 or 1) teach nothing; if no label can be learnt every score is 0.5; a null doc_id
counts as the empty text in the hash; rows are scored one by one, so repeated rows get equal scores; labels that
repeat or contradict each other all vote, and so do all labelled vectors that tie at the last place among the nearest;
a very long text is counted once in memory in proportion to its length; columns of docs pass through, names that begin
with __ are this operator's (__held_out, __score); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, stored, words

MODULUS, REMAINDER = 3, 1
SAMPLE, RANK, NEIGHBOURS, POWER = 6000, 48, 31, 8
STYLE, WORDS, WORD_SHARE = 512, 1024, 0.3
ROWS, MEMO = 128, 300_000


class Terms:
    """Texts to rows of two blocks of hashed terms; shapes and hashes of words are kept in a bounded memo."""

    def __init__(self):
        self.memo: dict[bytes, tuple[int, int]] = {}

    def _word(self, w: bytes) -> tuple[int, int]:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        shape: list[str] = []
        for c in w.decode():
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not shape or shape[-1] != k:
                shape.append(k)
            if len(shape) == 8:
                break
        out = self.memo[w] = (self._style("".join(shape)), xxhash.xxh64_intdigest(w.lower()) % WORDS)
        return out

    @staticmethod
    def _style(name: str) -> int:
        return xxhash.xxh64_intdigest(name.encode()) % STYLE

    def row(self, text: str | None) -> np.ndarray:
        """STYLE square roots of shares, then WORDS logarithms of counts."""
        out = np.zeros(STYLE + WORDS, np.float32)
        w = words(text)
        n = len(w)
        if not n:
            out[self._style("no words")] = 1
            return out
        counts = Counter(w)
        own = [self.memo.get(x) or self._word(x) for x in counts]
        at, times = np.array(own), np.fromiter(counts.values(), np.float32, len(counts))
        out[:STYLE] = np.bincount(at[:, 0], times, STYLE) / n
        out[STYLE:] = np.bincount(at[:, 1], np.log1p(times), WORDS)
        number = {x: i for i, x in enumerate(counts)}
        ids = np.fromiter(map(number.__getitem__, w), np.int64, n)
        out[self._style("same as before")] += np.count_nonzero(ids[1:] == ids[:-1]) / n
        if n > 2:
            triples = ids[2:] + len(counts) * (ids[1:-1] + len(counts) * ids[:-2])
            triples.sort()
            new = np.flatnonzero(np.r_[True, triples[1:] != triples[:-1], True])
            size = np.diff(new)
            out[self._style("repeated triples")] += size[size > 1].sum() / n
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        out[self._style("repeated lines")] += 1 - len(set(lines)) / len(lines)
        out[self._style(f"line of {min(12, int(log2(n / len(lines) + 1)))}")] += 1
        out[self._style(f"text of {min(14, int(log2(n + 1)))}")] += 1
        np.sqrt(out[:STYLE], out[:STYLE])
        return out

    def rows(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float32).reshape(-1, STYLE + WORDS)


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted by idf, the two blocks scaled to their shares."""
    x = x * idf
    for block, share in ((x[:, :STYLE], 1.0), (x[:, STYLE:], WORD_SHARE)):
        block *= share / np.maximum(np.sqrt((block * block).sum(1, keepdims=True)), 1e-9)
    return x


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, y, x): the terms and labels of the `sample` rows of least hash that have a label and are not held out. Cut on the executors: a label or a document that repeats a million times adds nothing to what the driver gets."""
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out_of("doc_id")).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"), F.xxhash64("doc_id", F.lit("quality")).alias("__h"))
    # The rows of the `sample` labels of least hash include all that can be among the least; the texts of no others are read.
    least = own.orderBy("__h", "__y").limit(sample)
    top = least.agg(F.max("__h")).first()[0]
    rows = docs.where(~held_out(MODULUS, REMAINDER)).join(own.where(F.col("__h") <= (top if top is not None else 0)), F.col("doc_id") == F.col("__id")).select("__h", "__y", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for f in frames:
            yield pd.DataFrame({"h": f["__h"], "y": f["__y"], "x": [r.astype(np.float16).tobytes() for r in terms.rows(f["text"])]})

    # Written, so that the cut ends in an executor: a collected limit would send every task's rows to the driver.
    return stored(rows.mapInPandas(run, "h long, y int, x binary").orderBy("h", "y", "x").limit(sample), "labelled")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(idf, directions, unit latent vectors, labels) of at most `sample` labelled rows that are not held out."""
    got = sorted(sampled(docs, labels, sample).collect(), key=lambda r: (r["h"], r["y"], r["x"]))
    if not got:
        return np.ones(STYLE + WORDS, np.float32), np.zeros((STYLE + WORDS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0)
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32)
    idf = np.minimum(np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1, 4.0).astype(np.float32)
    x = _weighted(x, idf)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    directions = np.ascontiguousarray(vectors[:, ::-1][:, :rank].astype(np.float32))
    return idf, directions, _unit(x @ directions), np.array([r["y"] for r in got], np.float64)


def held_out_of(name: str):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % MODULUS == REMAINDER


def vote(z: np.ndarray, known: np.ndarray, y: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """For unit rows z: the mean label of the nearest known vectors, weighted by similarity. All that tie at the last place vote."""
    if not y.size:
        return np.full(len(z), 0.5)
    s = z @ known.T
    k = min(neighbours, y.size)
    last = np.partition(s, y.size - k, axis=1)[:, y.size - k]
    row, at = np.nonzero(s >= last[:, None])
    w = np.maximum(s[row, at], 1e-6).astype(np.float64) ** power
    return np.clip(np.bincount(row, w * y[at], len(z)) / np.bincount(row, w, len(z)), 0.0, 1.0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> DataFrame:
    """docs plus __held_out and __score."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, rank))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        idf, directions, known, y = sent.value
        for b in batches:
            blocks = [vote(_unit(_weighted(terms.rows(b.iloc[i : i + ROWS]), idf) @ directions), known, y) for i in range(0, len(b), ROWS)]
            yield pd.Series(np.concatenate(blocks) if blocks else np.zeros(0))

    scored = F.pandas_udf(run, "double")
    return docs.withColumn("__held_out", held_out(MODULUS, REMAINDER)).withColumn("__score", scored(F.coalesce("text", F.lit(""))))
