"""Operator 13: phrases by vertical partitioning of a depth-truncated suffix tree.

The tree holds the suffixes of all pieces of all texts, cut to `longest` words. It is never built whole: suffixes are
split by word prefixes of variable length, the prefixes are put in groups of about BUDGET suffixes, and each group
builds its subtrees alone.

1. Words are counted and get 64-bit codes (their language is part of them). Codes of distinct words are compared over
   the whole table, and drawn anew from another seed if two coincide, so that from here on a code is a word.
2. Prefixes of two words are counted where both words are frequent. Those that are not frequent have no subtree that
   matters; those with more than BUDGET suffixes are lengthened by a word, counted again, and so on, to full depth,
   where a group is a count.
3. Suffixes of frequent prefixes go to the group that their prefix's hash names, cut where a word or a pair of words is
   infrequent (no frequent phrase holds it), and equal ones of a chunk merged. Sorted, their common prefixes are the
   nodes of the subtrees, and a node's count is the total of its leaves. Nodes above a lengthened prefix get theirs from
   several groups.

What tasks need to know of all the corpus (which words and pairs are frequent, which prefixes are long) they get as
bits by the codes' last digits, 16 for each that is set and at most MOST_BITS (16 MB), whatever the corpus. Bits that
coincide cost time, never a count: they only say what may be left out.

Phrases are then cut in two at each place. All counts are exact; products are decimals.

Defined results: null, empty and blank texts have no phrases; a null lang is `und`; repeated rows count each; a very
long text is read in one piece, its words held as numbers; other columns are not looked at; an empty table, or one
without frequent words, gives an empty result. Two words of one chunk whose codes coincide would be counted as one: at
a million distinct words a chunk the chance is 3e-8 for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import heavy, joined, released, stored

LONGEST, LEAST, BUDGET, TOP = 4, 30, 1 << 18, 2000
#: A phrase goes where a longer candidate holds it and has this share of its count or more.
OF, PARTS = 80, 100
MOST_BITS, PAGE = 1 << 27, 1 << 19
#: Bytes of text that are handled at once in a task, and rows that leave it at once: the JVM holds a batch outside its heap.
CHUNK, ROWS = 1 << 20, 1 << 16
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = 0x9E6C63D0876A9A47
_ROW = "w1 long, w2 long, w3 long, w4 long"


class Words(NamedTuple):
    """The words of some documents: code, first and last byte, document, and whether the next word is in the same piece."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    goes_on: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _R
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Reader:
    """Reads words of texts in bytes, without a Python step a word."""

    def __init__(self, seed: int):
        self.letters = np.random.default_rng(seed).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
        self.seed = seed
        self.up, self.down = _powers(_BASE, CHUNK // 4), _powers(pow(_BASE, -1, 1 << 64), CHUNK // 4)

    def _hashes(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, a = np.zeros(start.size, np.uint64), 0
        while a < start.size:
            b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK // 4, "right")))
            first, n = start[a], int(end[b - 1] - start[a])
            up, down = (self.up, self.down) if n <= CHUNK // 4 else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.letters[low[first : first + n]] * up[:n], out=sums[1:])
            s, e = start[a:b] - first, end[a:b] - first
            out[a:b] = (sums[e] - sums[s]) * down[s]
            a = b
        return out

    def words(self, low: np.ndarray, bounds: np.ndarray, lang: np.ndarray) -> Words:
        """Of the documents between these bounds in lower-case bytes; lang has a hash of each one's language."""
        kind = _KIND[low]
        new = np.zeros(low.size + 1, bool)
        new[bounds] = True
        new[-1] = True
        inside = kind == 0
        start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | new[:-1]))
        end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | new[1:])) + 1
        doc = np.repeat(np.arange(bounds.size - 1), np.diff(np.searchsorted(start, bounds)))
        piece = np.cumsum((kind == _BREAK) | new[:-1], dtype=np.int32)[start]
        code = _mix(self._hashes(low, start, end) + lang[doc] + (end - start).astype(np.uint64) * _Q)
        return Words(np.where(code == 0, _P, code), start, end, doc, np.r_[piece[1:] == piece[:-1], False][: start.size])


def _read(reader: Reader, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray, Words]]:
    """(lower-case bytes, where the words' places begin in them, row of each document, words) for each chunk of a batch (lang, text)."""
    text = pc.fill_null(batch["text"], "").cast(pa.large_string())
    text = pa.concat_arrays([text])
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    names = batch["lang"].to_pylist()
    known = {x: xxhash.xxh64_intdigest(x.encode(), reader.seed) for x in set(names)}
    lang = np.array([known[x] for x in names], np.uint64)
    a = 0
    while a < len(names):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        low = _LOWER[raw[bounds[a] : bounds[b]]]
        yield low, 0, np.arange(a, b), reader.words(low, bounds[a : b + 1] - bounds[a], lang[a:b])
        a = b


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, a place of each, and their summed counts."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if s.size else np.zeros(0, np.int64)
    return s[head], order[head], np.add.reduceat(counts[order], head) if s.size else counts


def _scan(docs: DataFrame, seed: int, emit: Callable, schema: str) -> DataFrame:
    """What emit makes of each chunk; docs has lang and text. A chunk's rows leave before the next one is read, so a task's memory does not follow the size of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        for b in batches:
            for chunk in _read(reader, b) if b.num_rows else ():
                out = emit(b, *chunk)
                for i in range(0, out.num_rows, ROWS):
                    yield out.slice(i, ROWS)

    return docs.mapInArrow(run, schema)


def _count_words(b: pa.RecordBatch, low: np.ndarray, first: int, row: np.ndarray, w: Words) -> pa.RecordBatch:
    code, at, n = _merged(w.code, np.ones(w.code.size, np.int64))
    totals: dict[str, int] = {}
    own = b["lang"].slice(int(row[0]), row.size)
    for x, k in zip(own.to_pylist(), np.bincount(w.doc, minlength=row.size).tolist(), strict=True):
        totals[x] = totals.get(x, 0) + k
    start, end = w.start[at], w.end[at]
    data = low[first : first + int(w.end[-1]) if w.end.size else first].tobytes()
    word = pa.array([data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())
    # A row without a word holds the language's total.
    sums = pa.array([xxhash.xxh64_intdigest(b"total\0" + x.encode()) for x in totals], pa.uint64())
    parts = [(pa.array(code), sums), (own.take(pa.array(w.doc[at])), pa.array(list(totals), pa.string())), (word, pa.nulls(len(totals), pa.string())), (pa.array(n), pa.array(list(totals.values()), pa.int64()))]
    code, lang, word, n = (pa.concat_arrays(x) for x in parts)
    return pa.RecordBatch.from_arrays([code.view(pa.int64()), lang, word, n], names=["code", "lang", "word", "n"])


def has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the bit of each code is set."""
    at = codes & np.uint64(bits.size * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(codes: DataFrame, count: int) -> np.ndarray:
    """A bit for each code (a column of that name), by its last digits; as many pages go through the driver as MOST_BITS allows."""
    size = min(MOST_BITS, max(PAGE, 1 << (16 * max(count, 1) - 1).bit_length()))
    at = F.expr(f"code & {size - 1}L")
    held = codes.select(at.alias("at")).groupBy(F.expr("cast(at >> 3 as int)").alias("byte")).agg(F.expr("bit_or(1 << cast(at & 7 as int))").alias("bits"))

    def page(t: pa.Table) -> pa.Table:
        out, at = np.zeros(PAGE // 8, np.uint8), t["byte"].to_numpy()
        out[at % (PAGE // 8)] = t["bits"].to_numpy()
        return pa.table({"page": pa.array([int(at[0]) // (PAGE // 8)], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in held.groupBy(F.floor(F.col("byte") / (PAGE // 8)).alias("page")).applyInArrow(page, "page int, data binary").collect():
        out[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = np.frombuffer(r["data"], np.uint8)
    return out


def _runs(w: Words, frequent: np.ndarray, depth: int, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, words) of the suffixes whose first two words may be a frequent pair: `depth` codes each, 0 from the first on that no frequent phrase can hold."""
    code = np.where(has(frequent, w.code), w.code, np.uint64(0))
    after = np.r_[code[1:], np.zeros(1, np.uint64)][: code.size]
    ok = w.goes_on & (code > 0) & (after > 0)
    if pairs is not None:
        at = np.flatnonzero(ok)
        ok[at] = has(pairs, joint([code[at], after[at]]))
    place = np.flatnonzero(ok)
    out, on = np.zeros((place.size, depth), np.uint64), np.ones(place.size, bool)
    if place.size:
        out[:, 0] = code[place]
        for d in range(1, depth):
            on &= ok[np.minimum(place + d - 1, ok.size - 1)]
            out[on, d] = code[place[on] + d]
    return place, out


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """A code of several codes in a row."""
    h = columns[0].copy()
    for c in columns[1:]:
        h = _mix(h * _P + c)
    return h


def prefixes(docs: DataFrame, seed: int, length: int, frequent: np.ndarray, pairs: np.ndarray | None, long: dict[int, np.ndarray]) -> DataFrame:
    """(code, n) of the prefixes of this many words, of those whose shorter prefixes are all too long for a group (all, of two words)."""

    def emit(b: pa.RecordBatch, low: np.ndarray, first: int, row: np.ndarray, w: Words) -> pa.RecordBatch:
        _, s = _runs(w, frequent, length, pairs)
        for k in range(2, length):
            s = s[has(long[k], joint([s[:, j] for j in range(k)]))]
        code, _, n = _merged(joint([s[:, j] for j in range(length)]), np.ones(len(s), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return _scan(docs, seed, emit, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, seed: int, frequent: np.ndarray, pairs: np.ndarray, long: dict[int, np.ndarray], groups: int) -> DataFrame:
    """(group, depth, w1..w4, n): the cut suffixes of each group, those of a chunk merged; depth is the length of the prefix that put them there."""

    def emit(b: pa.RecordBatch, low: np.ndarray, first: int, row: np.ndarray, w: Words) -> pa.RecordBatch:
        s = _runs(w, frequent, LONGEST, pairs)[1]
        order = np.argsort(joint([s[:, j] for j in range(LONGEST)]))
        s = s[order]
        head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]).any(1)]) if len(s) else np.zeros(0, np.int64)
        n = np.diff(np.r_[head, len(s)])
        s = s[head]
        depth, prefix = np.full(len(s), 2, np.int32), joint([s[:, 0], s[:, 1]])
        for k in range(2, LONGEST):
            further = (depth == k) & has(long[k], prefix) if k in long else np.zeros(len(s), bool)
            depth[further] = k + 1
            prefix[further] = joint([s[further, j] for j in range(k + 1)])
        group = (prefix % np.uint64(groups)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(depth), *(pa.array(s[:, j].copy().view(np.int64)) for j in range(LONGEST)), pa.array(n)], names=["group", "depth", "w1", "w2", "w3", "w4", "n"])

    return _scan(docs, seed, emit, f"group long, depth int, {_ROW}, n long")


def subtrees(t: pa.Table, least: int) -> pa.Table:
    """(key, n): the nodes of two words or more of one group's subtrees, with the total of their leaves; key has the codes of the words, eight bytes each."""
    s = np.stack([t[f"w{j + 1}"].to_numpy().view(np.uint64) for j in range(LONGEST)], 1)
    order = np.lexsort(s.T[::-1])
    s, n, depth = s[order], t["n"].to_numpy()[order], t["depth"].to_numpy()[order]
    same = s[1:] == s[:-1]
    keys, counts = [], []
    for d in range(2, LONGEST + 1):
        # Suffixes whose common prefix is d words or longer are leaves below one node of that depth.
        head = np.flatnonzero(np.r_[True, ~same[:, :d].all(1)])
        total = np.add.reduceat(n, head)
        kept = (s[head, d - 1] > 0) & ((total >= least) | (depth[head] > d))
        data = s[head[kept], :d].astype(">u8").tobytes()
        keys.append(pa.Array.from_buffers(pa.binary(), int(kept.sum()), [None, pa.py_buffer(np.arange(0, len(data) + 1, 8 * d, dtype=np.int32)), pa.py_buffer(data)]))
        counts.append(total[kept])
    return pa.table({"key": pa.concat_arrays(keys), "n": pa.array(np.concatenate(counts), pa.int64())})


def _key(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code), 16, "0"))


def counted(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): the words (key, lang, word, n) and phrases (key, n) found `least` times or more, and the words of each language (lang, n), all three stored."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    seed, two = 0, True
    while two:
        seed += 1
        own = F.struct("lang", "word")
        each = _scan(texts, seed, _count_words, "code long, lang string, word string, n long").groupBy("code").agg(F.sum("n").alias("n"), F.min(own).alias("own"), F.max(own).alias("other"))
        every = stored(each.where((F.col("n") >= least) | F.col("own.word").isNull() | ~F.col("own").eqNullSafe(F.col("other"))), "phrases-words")
        two = bool(every.where(~F.col("own").eqNullSafe(F.col("other"))).head(1))
        if two:
            released(every)
    words = every.where("own.word is not null").select("code", _key(F.col("code")).alias("key"), "own.lang", "own.word", "n")
    totals = every.where("own.word is null").select("own.lang", "n")
    n_frequent = words.count()
    frequent = bits_of(words, n_frequent)

    pairs, long, length, suffix_rows = None, {}, 2, 0
    while length < LONGEST:
        found = prefixes(texts, seed, length, frequent, pairs, long)
        kept = stored(found.where(F.col("n") >= (least if length == 2 else budget)), "phrases-prefixes")
        r = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > budget, 1))).first()
        if length == 2:
            pairs, suffix_rows = bits_of(kept, r[0]), int(r[1])
        if r[2]:
            long[length] = bits_of(kept.where(F.col("n") > budget), r[2])
        released(kept)
        if not r[2]:
            break
        length += 1

    groups = max(1, -(-suffix_rows // budget), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = suffixes(texts, seed, frequent, pairs, long, groups).groupBy("group").applyInArrow(lambda t: subtrees(t, least), "key binary, n long")
    phrases = stored(nodes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    return words, phrases, totals


def _cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, a, l, r, score) of each phrase by its lowest-scoring cut."""
    k = F.explode(F.sequence(F.lit(1), (F.length("key") / 8).cast("int") - 1))
    cuts = phrases.select("key", F.col("n").alias("a"), k.alias("k")).select("key", "a", "k", F.substring("key", F.lit(1), F.col("k") * 8).alias("first"), F.substring("key", F.col("k") * 8 + 1, F.length("key")).alias("rest"))
    cuts = stored(cuts, "phrases-cuts")
    for side, name in (("first", "l"), ("rest", "r")):
        hot = heavy(cuts.groupBy(side).agg(F.count(F.lit(1)).alias("n")), side)
        cuts = stored(joined(cuts, counts.select(F.col("key").alias(side), F.col("n").alias(name)), [side], hot), "phrases-cuts")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("key", "a", "c.l", "c.r", "c.score")


def _not_held(phrases: DataFrame) -> DataFrame:
    """The phrases that no longer one with enough of their count holds."""
    m = (F.length("key") / 8).cast("int")
    parts = F.expr(f"flatten(transform(sequence(2, {LONGEST}), d -> transform(filter(sequence(0, {LONGEST} - 2), i -> d < length(key) / 8 and i + d <= length(key) / 8), i -> substring(key, cast(8 * i + 1 as int), cast(8 * d as int)))))")
    inside = phrases.where(m > 2).select(F.explode(parts).alias("key"), "n").groupBy("key").agg(F.max("n").alias("most"))
    big = lambda c, x: F.col(c).cast("decimal(19,0)") * F.lit(x)
    return phrases.join(inside, "key", "left").where(F.col("most").isNull() | (big("most", PARTS) < big("n", OF))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language."""
    words, phrases, totals = counted(docs, least, budget)
    scored = stored(_cuts(stored(_not_held(phrases), "phrases-free"), words.select("key", "n").unionByName(phrases)), "phrases-scored")
    spelt = scored.select("key", F.explode(F.expr("transform(sequence(1, cast(length(key) / 8 as int)), i -> struct(i as i, substring(key, cast(8 * i - 7 as int), 8) as word_key))")).alias("x")).select("key", "x.i", "x.word_key")
    spelt = stored(spelt, "phrases-spelt")
    hot = heavy(spelt.groupBy("word_key").agg(F.count(F.lit(1)).alias("n")), "word_key")
    named = joined(spelt, words.select(F.col("key").alias("word_key"), "lang", "word"), ["word_key"], hot)
    text = named.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))
    full = scored.join(text, "key")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The first of each of 64 parts of a language, then the first of those.
    part = F.pmod(F.xxhash64("key"), F.lit(64))
    some = full.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
