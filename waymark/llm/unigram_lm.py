"""Operator 10: language-model scores as the likelihood of a subword lattice.

The pieces come from an existing vocabulary file, whose scores weigh the segmentations. A word, with the word-start mark
before it, is a lattice of all its segmentations into pieces and bytes; a forward recursion in log space sums them to
the word's marginal probability, and a document's probability is the product over its words and one end.

The file's scores weight the pieces by one rule (vocabulary()): scores that are probabilities are taken as they are;
scores that are ranks (0, -1, -2, ...; the public file has these) stand for Zipf's law, so that a piece weighs
1 / (ZIPF - score); byte pieces have no score of their own and weigh as much as the last piece. By these weights each
training word is divided among its segmentations, and each piece gets the number of times that it is then expected
(forward and backward sums, each distinct word once, by its count). Those numbers, with PRIOR more in the shares of the
file's weights, are the model's weights; an end is one more piece, with its own count. With fewer training words than
the file has pieces, less than one for each weight, nothing is fitted: the file's weights hold, beside the share of ends.

Words and their counts form a table that grows with the corpus. Its most frequent words, at most HEAVY of at most
HEAVY_BYTES bytes each, are broadcast; a document's other words are joined to the table, counted per document first.

Defined results: a null text is the empty text, which is one end; a null doc_id has crc32 of the empty text; repeated
rows each give a row and each count; a very long word goes through the recursion in a sliding window, with time in
proportion to its length and memory that does not depend on it (learning from one holds two sums a letter); extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import FEW
from ._common import HEAVY as SHARE
from ._common import held_out, joined, row_key, stored, words

MODULUS, REMAINDER = 7, 2
HEAVY, HEAVY_BYTES, FLUSH = 100_000, 64, 300_000
ZIPF = 10
#: Pieces that are counted in the shares of the file's weights beside those of the training words.
PRIOR = 1000
_MARK = "▁"
_NEVER = -1e300
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places times lengths that are worked on at once; places from which a word is long, and of one window of it.
_CELLS, _LONG = 1 << 19, 4096
_BYTE = re.compile("<0x[0-9A-F]{2}>")


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """The pieces of a sentencepiece file, without control pieces, each byte piece as <0x..>; and their log weights, which sum to 1 as weights."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))]
    pieces = [m.id_to_piece(i) for i in ids]
    scores = [m.get_score(i) for i, p in zip(ids, pieces, strict=True) if not _BYTE.fullmatch(p)]
    least = min(scores, default=0.0)
    ranked = least <= -max(100, len(scores) / 2) and all(x == int(x) for x in scores)
    weigh = (lambda x: -log(ZIPF - x)) if ranked else (lambda x: x)
    logs = [weigh(least if _BYTE.fullmatch(p) else m.get_score(i)) for i, p in zip(ids, pieces, strict=True)]
    whole = log(sum(map(exp, logs)))
    return pieces, [x - whole for x in logs]


class Lattice:
    """Sums over all segmentations of words, given the log weight of each piece; words of like length go through each step together."""

    def __init__(self, pieces: list[str], weights: list[float]):
        self.bytes = {int(p[3:5], 16): w for p, w in zip(pieces, weights, strict=True) if _BYTE.fullmatch(p)}
        own: dict[int, list[tuple[int, float]]] = {}
        for p, w in zip(pieces, weights, strict=True):
            if p and not _BYTE.fullmatch(p):
                own.setdefault(len(p), []).append((_hash(p), w))
        self.longest = max(own, default=1)
        #: For each length the sorted hashes of its pieces, and their log weights.
        self.tables = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([w for _, w in sorted(x)])) for n, x in own.items()}
        at = {(len(p), _hash(p)): i for i, p in enumerate(pieces)}
        #: Beside the tables: the place of each piece in the list of all; and of each byte.
        self.places = {n: np.array([at[n, int(h)] for h in x[0]]) for n, x in self.tables.items()}
        self.byte_places = {int(p[3:5], 16): i for i, p in enumerate(pieces) if _BYTE.fullmatch(p)}
        self.size = len(pieces)
        self.letters: dict[int, float] = {}

    def _spelled(self, letter: int) -> float:
        """The log weight of a letter written in byte pieces."""
        if letter not in self.letters:
            own = [self.bytes.get(b) for b in chr(letter).encode()]
            self.letters[letter] = _NEVER if None in own else sum(own)
        return self.letters[letter]

    def _chunks(self, texts: list[str]):
        """Indexes, code points (0 beyond the end) and lengths of words of like length."""
        size = np.array([len(t) for t in texts], np.int64) + 1
        order = np.argsort(size, kind="stable")
        order = order[: np.searchsorted(size[order], _LONG)]
        at = 0
        while at < order.size:
            n = min(order.size - at, max(1, _CELLS // (self.longest * int(size[order[at]]))))
            while n > 1 and n * int(size[order[at + n - 1]]) * self.longest > 2 * _CELLS:
                n //= 2
            i = order[at : at + n]
            width = int(size[i[-1]])
            codes = np.zeros((n, width + self.longest), np.uint32)
            for r, k in enumerate(i):
                codes[r, : size[k]] = np.frombuffer((_MARK + texts[k]).encode("utf-32-le"), np.uint32)
            yield i, codes, size[i], width
            at += n

    def _hits(self, codes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, where its pieces begin, which they are in its table)."""
        h = np.zeros((len(codes), width), np.uint64)
        for k in range(self.longest):
            c = codes[:, k : k + width]
            h = h * _BASE + c
            if k + 1 in self.tables:
                keys = self.tables[k + 1][0]
                at = np.minimum(np.searchsorted(keys, h), keys.size - 1)
                hit = (keys[at] == h) & (c > 0)
                yield k + 1, hit, at[hit]

    def _letters(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct letters, which of them is at each place, and its log weight if spelled in bytes."""
        letters, which = np.unique(codes[:, :width], return_inverse=True)
        which = which.reshape(len(codes), width)
        return letters, which, np.array([self._spelled(int(x)) if x else _NEVER for x in letters])[which]

    def _edges(self, codes: np.ndarray, width: int) -> np.ndarray:
        """The log weight of each place and length."""
        w = np.full((len(codes), width, self.longest), _NEVER)
        for k, hit, at in self._hits(codes, width):
            w[..., k - 1][hit] = self.tables[k][1][at]
        w[..., 0] = np.logaddexp(w[..., 0], self._letters(codes, width)[2])
        return w

    def _forward(self, w: np.ndarray, width: int) -> np.ndarray:
        a = np.full((len(w), width + 1), _NEVER)
        a[:, 0] = 0
        for j in range(1, width + 1):
            k = min(j, self.longest)
            a[:, j] = _log_sum(np.stack([a[:, j - x] + w[:, j - x, x - 1] for x in range(1, k + 1)], axis=1))
        return a

    def _backward(self, w: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        b = np.full((len(w), width + 1), _NEVER)
        for j in range(width, -1, -1):
            k = min(width - j, self.longest)
            if k:
                b[:, j] = _log_sum(np.stack([b[:, j + x] + w[:, j, x - 1] for x in range(1, k + 1)], axis=1))
            b[size == j, j] = 0
        return b

    def _windows(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first place, places, code points) of the windows of a long word."""
        reach, total = self.longest, len(text) + 1
        for at in range(0, total, _LONG):
            width = min(_LONG, total - at)
            part = (_MARK + text[: at + width + reach - 1])[at:] if at == 0 else text[at - 1 : at - 1 + width + reach]
            codes = np.zeros((1, width + reach), np.uint32)
            points = np.frombuffer(part.encode("utf-32-le"), np.uint32)[: width + reach]
            codes[0, : points.size] = points
            yield at, width, codes

    def _long(self, text: str, every: np.ndarray | None = None) -> float:
        """One long word, in windows of _LONG places; only the last `longest` sums go on to the next. every gets the sum of each place."""
        reach = self.longest
        ahead = [0.0] + [_NEVER] * (reach - 1)
        for at, width, codes in self._windows(text):
            w = self._edges(codes, width)[0]
            a = ahead + [_NEVER] * width
            place, k = np.nonzero(w > _NEVER / 2)
            for i, n, x in zip(place.tolist(), (k + 1).tolist(), w[place, k].tolist(), strict=True):
                a[i + n] = _log_add(a[i + n], a[i] + x)
            ahead = a[width : width + reach]
            if every is not None:
                every[at : at + width + 1] = a[: width + 1]
        return ahead[0]

    def _long_expected(self, text: str, times: float, out: np.ndarray) -> None:
        a, b = np.full(len(text) + 2, _NEVER), np.full(len(text) + 2 + self.longest, _NEVER)
        whole, b[len(text) + 1] = self._long(text, a), 0.0
        for at, width, codes in [*self._windows(text)][::-1]:
            w = self._edges(codes, width)[0]
            own = b[at : at + width + self.longest + 1].tolist()
            place, k = np.nonzero(w > _NEVER / 2)
            for i, n, x in zip(place[::-1].tolist(), (k[::-1] + 1).tolist(), w[place, k][::-1].tolist(), strict=True):
                own[i] = _log_add(own[i], own[i + n] + x)
            b[at : at + width] = own[:width]
            self._add(codes, width, a[None, at : at + width], b[None, at : at + width + self.longest + 1], np.array([whole]), np.array([times]), out)

    def _add(self, codes: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, whole: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        """Adds to out how often each piece is expected in these words, which occur so many times."""
        for k, hit, at in self._hits(codes, width):
            r, j = np.nonzero(hit)
            share = np.exp(np.minimum(a[r, j] + self.tables[k][1][at] + b[r, j + k] - whole[r], 0.0))
            out += np.bincount(self.places[k][at], share * times[r], self.size)
        letters, which, spelled = self._letters(codes, width)
        share = np.exp(np.clip(a[:, :width] + spelled + b[:, 1 : width + 1] - whole[:, None], -700, 0)) * times[:, None]
        for x, n in zip(letters.tolist(), np.bincount(which.ravel(), np.where(spelled > _NEVER / 2, share, 0.0).ravel(), letters.size).tolist(), strict=True):
            for byte in chr(x).encode() if n else b"":
                out[self.byte_places[byte]] += n

    def expected(self, texts: list[str], times: list[float]) -> np.ndarray:
        """How often each piece is expected in these words, each divided among its segmentations by their weights. A word without a segmentation adds nothing."""
        out, times = np.zeros(self.size), np.array(times, np.float64)
        for i, codes, size, width in self._chunks(texts):
            w = self._edges(codes, width)
            a, b = self._forward(w, width), self._backward(w, size, width)
            whole = a[np.arange(len(i)), size]
            self._add(codes, width, a, b, whole, np.where(whole > _NEVER / 2, times[i], 0.0), out)
        for i, t in enumerate(texts):
            if len(t) + 1 >= _LONG:
                self._long_expected(t, times[i], out)
        return out

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, codes, size, width in self._chunks(texts):
            a = self._forward(self._edges(codes, width), width)
            out[i] = a[np.arange(len(i)), size]
        for i, t in enumerate(texts):
            if len(t) + 1 >= _LONG:
                out[i] = self._long(t)
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c)) % (1 << 64)
    return h


def _log_add(x: float, y: float) -> float:
    return y if x <= _NEVER / 2 else max(x, y) + log1p(exp(-abs(x - y)))


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(1)
    return top + np.log(np.exp(np.maximum(terms - top[:, None], -700)).sum(1))


def tokens(text: str | None) -> list[str]:
    return [w.decode() for w in words(text.encode().lower().decode())] if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): of every word of the corpus, how often it occurs in training documents and in all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learn: Counter = Counter()
        other: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(w, k, k + other.pop(w, 0)) for w, k in learn.items()] + [(w, 0, k) for w, k in other.items()]
            return pd.DataFrame(rows, columns=["word", "c", "n"])

        for f in frames:
            for t, h in zip(f["text"], f["held"], strict=True):
                (other if h else learn).update(tokens(t))
                if len(learn) + len(other) > FLUSH:
                    yield out()
                    learn.clear(), other.clear()
        yield out()

    return docs.select("text", held_out(MODULUS, REMAINDER).alias("held")).mapInPandas(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def scored_words(counts: DataFrame, pieces: list[str], weights: list[float]) -> DataFrame:
    """counts plus lattice: each word's log10 marginal probability."""
    sent = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*sent.value)
        for f in frames:
            yield f.assign(lattice=lattice.log_probabilities(f["word"].tolist()) / log(10))

    return counts.mapInPandas(run, "word string, c long, n long, lattice double")


def fitted(counts: DataFrame, pieces: list[str], weights: list[float]) -> tuple[np.ndarray, float]:
    """Log weights of the pieces by what the training words are expected to hold of each, and how many pieces those words hold. What goes to the driver is a number a piece and task."""
    sent = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*sent.value)
        own = np.zeros(lattice.size)
        for f in frames:
            own += lattice.expected(f["word"].tolist(), f["c"].tolist())
        yield pd.DataFrame({"piece": np.flatnonzero(own), "n": own[own > 0]})

    rows = counts.where("c > 0").select("word", "c").mapInPandas(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(pieces))
    n[[r["piece"] for r in rows]] = [r["n"] for r in rows]
    return np.log(n + PRIOR * np.exp(weights)) - log(n.sum() + PRIOR), float(n.sum())


def _frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The words of at least a certain count, which is the least power of two that leaves at most so many."""
    steps = vocab.groupBy(F.floor(F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return vocab.where(F.col("n") >= (1 << int(least)) if least is not None else F.lit(False)).where(F.octet_length("word") <= HEAVY_BYTES)


def score(docs: DataFrame, path: str, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "words")
    ends = docs.where(~held_out(MODULUS, REMAINDER)).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_train, n_distinct = sums[0] + ends, sums[1] + (ends > 0)
    pieces, weights = vocabulary(path)
    total = sums[0]
    if sums[0] >= len(pieces):
        weights, total = fitted(counts, pieces, weights)
    share = (ends + 1) / (total + ends + 2)  # of ends among what the training documents are made of
    weights, end = [float(x) + log1p(-share) for x in weights], log(share)
    vocab = stored(scored_words(counts, pieces, weights), "words-scored")
    base = log10(n_train + n_distinct + 1)
    frequent = {r["word"]: (r["c"], log10(r["c"] + 1) - base, r["lattice"]) for r in _frequent(vocab, heavy).select("word", "c", "lattice").collect()}
    sent = spark.sparkContext.broadcast(frequent)
    of_end = (log10(ends + 1) - base, end / log(10), int(ends > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kinds = {"rid": pa.binary(), "doc_id": pa.int64(), "held": pa.bool_(), "word": pa.string(), "times": pa.int64(), "head": pa.list_(pa.float64())}

        def rows(**columns) -> pa.RecordBatch:
            n = len(columns["rid"])
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            head, rid, word, times = [], [], [], []
            own_rid = batch.column("rid").to_pylist()
            for r, t in zip(own_rid, batch.column("text"), strict=True):
                own = Counter(tokens(t.as_py()))
                n, k, b, s = 1, of_end[2], of_end[0], of_end[1]
                for w, c in own.items():
                    n += c
                    got = known.get(w)
                    if got is None:
                        rid.append(r), word.append(w), times.append(c)
                    else:
                        k, b, s = k + c * (got[0] > 0), b + c * got[1], s + c * got[2]
                head.append([n, k, b, s])
            # A document's own row has a key with a space, which no word has.
            yield rows(rid=own_rid, doc_id=batch.column("doc_id").to_pylist(), held=batch.column("held").to_pylist(), word=[f" {r.hex()}" for r in own_rid], times=[0] * len(own_rid), head=head)
            yield rows(rid=rid, word=word, times=times)

    keyed = docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long"), held_out(MODULUS, REMAINDER).alias("held"), "text")
    parts = keyed.mapInArrow(run, "rid binary, doc_id long, held boolean, word string, times long, head array<double>")
    # Words too long to be sent, but in very many documents, are split from the join.
    often = max(vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / SHARE, FEW)
    hot = vocab.where((F.octet_length("word") > HEAVY_BYTES) & (F.col("n") > often)).select("word", F.lit(True).alias("__hot"))
    some = bool(hot.head(1))
    met = joined(stored(parts, "words-of-documents") if some else parts, vocab.select("word", "c", "lattice"), ["word"], hot if some else None, "left")

    def total(own: int, rest: Column) -> Column:
        return F.sum(F.coalesce(F.element_at("head", own), rest, F.lit(0.0)))

    times = F.col("times").cast("double")
    sums = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.count("head").alias("copies"), total(1, F.lit(0.0)).alias("n"), total(2, F.when(F.col("c") > 0, times)).alias("k"),
        total(3, times * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(base))).alias("b"), total(4, times * F.col("lattice")).alias("s"),
    )
    each = [(F.col(x) / F.col("copies")) for x in "nkbs"]
    return sums.select("doc_id", "held_out", F.round(each[0]).cast("long").alias("n_tokens"), F.round(each[1]).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), each[2].alias("base_score"), each[3].alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
