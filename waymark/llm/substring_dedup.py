"""Operator 1: substring dedup by prefix-partitioned suffix trees.

Only the first `window` words of a suffix matter: two suffixes share a repeat if their paths in the suffix tree part at
that depth or deeper. The suffixes are split by prefixes of variable length: a suffix's prefix ends with the word
K-gram of least hash among those in its first `window` words (the anchor), so it is K to `window` words long, and equal
suffixes have equal prefixes. Neighbouring suffixes, whose prefixes end with the same anchor, share one group and one
stretch of text.

1. Every document emits its anchors (hash and place, about one for twelve words). An anchor hash that occurs once
   is a prefix of one suffix each, and holds no repeat; it goes.
2. For the others a document emits the stretch of text around the anchor. All stretches of one hash are a group of
   bounded size. Equal stretches are one path of the group's tree. Where there are several, their suffixes are sorted
   to a suffix array by doubling ranks, and the common prefixes of neighbours in it are the tree's branching nodes: the
   greater of a suffix's two is the string depth of its leaf's parent. A parent of `window` words or more is a deep
   internal node, and its string is a repeat; united along a document these are the maximal repeats.
3. A hash with more than GROUP occurrences would be too large for memory, so the prefix of its suffixes is lengthened
   to the full depth: there the suffix's node is known by its prefix, and has two leaves or more if that occurs twice.
   Equal suffixes of a task are merged first. (Lengths between bring no more: with every word of the window in the
   prefix, a group is a count.)

Words are 64-bit hashes and anchors count as one word, full-depth prefixes are 128-bit hashes. Each document drops the
words that its repeats cover.

Defined results: null, empty and short texts have no repeats; repeated rows are documents of their own, so they repeat
one another; a null doc_id is an id like any other; a very long text is read in one piece, its words held as numbers;
columns of docs pass through, names that begin with __ are this operator's (__rid, __hits, __spans, __n_words,
__n_removed, __kept); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, row_key, stored, words

WINDOW, K, GROUP = 35, 12, 2000
#: Words that are handled at once in a task, and suffixes in one build of subtrees.
CHUNK, BUILD = 200_000, 100_000
_STRETCH, _SUFFIX, _DONE = 0, 1, 2
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _R
    return x ^ (x >> np.uint64(32))


def _rolled(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """The hash of every k codes in a row."""
    n = codes.size - k + 1
    out = codes[:n].copy()
    for j in range(1, k):
        out = out * base + codes[j : j + n]
    return _mix(out)


def _codes(text_words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text_words), np.uint64, len(text_words))


def _anchors(codes: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, hash, first, last) of each anchor in concatenated documents: windows starting at first..last have it."""
    n = codes.size - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = _rolled(codes, k, _P)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(1) + np.arange(n)
    p = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not p.size:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    m = at[p]
    head = np.flatnonzero(np.r_[True, (np.diff(m) != 0) | (np.diff(p) != 1)])
    tail = np.r_[head[1:] - 1, p.size - 1]
    return m[head], grams[m[head]], p[head], p[tail]


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with the codes of their words, CHUNK words or one document at a time: (rows, codes, row of each word, start of each row)."""
    for f in frames:
        held: list[np.ndarray] = []
        first = size = 0
        for i, t in enumerate(f["text"]):
            held.append(_codes(words(t)))
            size += held[-1].size
            if size >= CHUNK or i == len(f) - 1:
                n = [c.size for c in held]
                yield f.iloc[first : i + 1], np.concatenate(held), np.repeat(np.arange(len(n)), n), np.cumsum([0, *n[:-1]])
                held, first, size = [], i + 1, 0


def _emit_anchors(window: int, k: int):
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, codes, doc, start in _chunks(frames):
            m, h, _, _ = _anchors(codes, doc, window, k)
            yield pd.DataFrame({"h": h.view(np.int64), "rid": rows["__rid"].to_numpy()[doc[m]], "place": (m - start[doc[m]]).astype(np.int32)})

    return emit


def _emit_stretches(window: int, k: int):
    """Rows (h, kind, rid, first, data) for the anchors named in __hits as place * 2 + (1 if too frequent)."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, codes, doc, start in _chunks(f.assign(text=f["text"].where(f["__hits"].notna(), None)) for f in frames):
            m, h, first, last = _anchors(codes, doc, window, k)
            d, place = doc[m], m - start[doc[m]]
            hits = [np.asarray(x if x is not None else (), np.int64) for x in rows["__hits"]]
            wanted = np.concatenate([x + (i << 40) for i, x in enumerate(hits)]) if hits else np.zeros(0, np.int64)
            label = (place << 1) + (d.astype(np.int64) << 40)
            plain, often = np.isin(label, wanted), np.isin(label + 1, wanted)
            rid = rows["__rid"].to_numpy()
            i = np.flatnonzero(plain)
            data = [codes[a:c].tobytes() + x.tobytes() + codes[c + k : b + window].tobytes() for a, b, c, x in zip(first[i], last[i], m[i], h[i], strict=True)]
            yield pd.DataFrame({"h": h[i].view(np.int64), "kind": _STRETCH, "rid": rid[d[i]], "first": (first[i] - start[d[i]]).astype(np.int32), "data": data})
            if not often.any():
                continue
            n = (last - first + 1)[often]
            p = np.repeat(first[often] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            one, two = _rolled(codes, window, _P)[p], _rolled(codes, window, _R)[p]
            order = np.lexsort((two, one))
            same = np.r_[False, (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)]
            again = np.zeros(p.size, bool)
            again[order] = same | np.r_[same[1:], False]
            lead = np.zeros(p.size, bool)
            lead[order] = ~same
            s = np.flatnonzero(lead)
            yield pd.DataFrame({"h": one[s].view(np.int64), "kind": _SUFFIX, "rid": rid[doc[p[s]]], "first": (p[s] - start[doc[p[s]]]).astype(np.int32), "data": [x.tobytes() for x in two[s]]})
            s = np.flatnonzero(again)
            s = s[np.argsort(p[s], kind="stable")]
            a, b = _runs(doc[p[s]], p[s])
            yield pd.DataFrame({"h": _mix((p[s][a].astype(np.uint64) + one[s][a])).view(np.int64), "kind": _DONE, "rid": rid[doc[p[s][a]]], "first": (p[s][a] - start[doc[p[s][a]]]).astype(np.int32), "data": [int(x).to_bytes(8, "little") for x in p[s][b] - start[doc[p[s][b]]]]})

    return emit


def _runs(owner: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive p of one owner."""
    if not p.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (owner[1:] != owner[:-1])])
    return head, np.r_[head[1:] - 1, p.size - 1]


def parent_depths(paths: list[bytes], deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the suffix array of distinct paths (words of 8 bytes): (path, offset, depth) of each suffix of `deep` words or more; depth is how much of it another suffix begins with, the string depth of its leaf's parent, or 0 below `deep`."""
    size = np.array([len(x) // 8 for x in paths])
    start = np.cumsum(size + 1) - (size + 1)
    flat = np.empty(int((size + 1).sum()), np.int64)
    ends = start + size
    text = np.ones(flat.size, bool)
    text[ends] = False
    known, flat[text] = np.unique(np.frombuffer(b"".join(paths), np.uint64), return_inverse=True)
    flat[ends] = known.size + np.arange(size.size)  # each path has an end of its own
    ranks, reach = [flat], 1
    while reach < size.max() + 1:
        r = ranks[-1]
        after = np.zeros(r.size, np.int64)
        after[: r.size - reach] = r[reach:] + 1
        ranks.append(np.unique(r * (after.max() + 1) + after, return_inverse=True)[1])
        reach *= 2
    n = size - deep + 1
    path = np.repeat(np.arange(size.size), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = start[path] + offset
    order = np.argsort(ranks[-1][at], kind="stable")
    x, y = at[order][:-1], at[order][1:]
    same = np.zeros(x.size, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = x + same, y + same
        inside = (a < flat.size) & (b < flat.size)
        r = ranks[level]
        same += (1 << level) * (inside & (r[np.where(inside, a, 0)] == r[np.where(inside, b, 0)]))
    depth = np.zeros(at.size, np.int64)
    depth[order] = np.maximum(np.r_[0, same], np.r_[same, 0])
    return path, offset, np.where(depth >= deep, depth, 0)


def repeated_spans(h: np.ndarray, stretches: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, stop) in words of what repeats, for whole groups h of stretches, sorted by h and content. A stretch has its anchor as one word."""
    deep = window - k + 1
    new = np.r_[True, (h[1:] != h[:-1]) | (stretches[1:] != stretches[:-1])]
    content = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    times = np.diff(np.r_[heads, h.size])
    size = np.array([len(stretches[i]) // 8 for i in heads]) + k - 1
    own = h[heads]
    several = np.r_[False, own[1:] == own[:-1]] | np.r_[own[1:] == own[:-1], False]
    again = np.flatnonzero(times > 1)
    c, a, b = [again], [np.zeros(again.size, np.int64)], [size[again]]
    mixed = np.flatnonzero(several)
    if mixed.size or (times == 1).any():
        lone = np.flatnonzero(several | (times == 1))  # a single path can repeat itself
        path, offset, depth = parent_depths([stretches[heads[i]] for i in lone], deep)
        hit = depth > 0
        c.append(lone[path[hit]])
        a.append(offset[hit])
        b.append(offset[hit] + depth[hit] + k - 1)
    c, a, b = map(np.concatenate, (c, a, b))
    order = np.lexsort((a, c))
    c, a, b = c[order], a[order], b[order]
    # Spans of one content are united: they overlap or follow one another.
    far = np.maximum.accumulate(b + c * (1 << 32)) - c * (1 << 32) if c.size else b
    head = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (a[1:] > far[:-1])]) if c.size else np.zeros(0, np.int64)
    c, a, b = c[head], a[head], far[np.r_[head[1:] - 1, c.size - 1]] if c.size else far
    # Each stretch has the spans of its content.
    n_spans = np.bincount(c, minlength=heads.size)
    first = np.cumsum(n_spans) - n_spans
    row = np.repeat(np.arange(h.size), n_spans[content])
    which = first[content[row]] + np.arange(row.size) - np.repeat(np.cumsum(n_spans[content]) - n_spans[content], n_spans[content])
    return row, a[which], b[which]


def _find_repeats(window: int, k: int):
    """From rows sorted by h, kind and data: (rid, start, stop) of what repeats. The group that may go on in the next batch is held back; groups of stretches are bounded, and of lone suffixes only the last is held."""

    def solve(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s = b[b["kind"] == _STRETCH]
        if len(s):
            row, start, stop = repeated_spans(s["h"].to_numpy(), s["data"].to_numpy(), window, k)
            first = s["first"].to_numpy().astype(np.int64)[row]
            yield pd.DataFrame({"rid": s["rid"].to_numpy()[row], "start": (first + start).astype(np.int32), "stop": (first + stop).astype(np.int32)})
        done = b[b["kind"] == _DONE]
        if len(done):
            yield pd.DataFrame({"rid": done["rid"].to_numpy(), "start": done["first"].to_numpy(np.int32), "stop": np.array([int.from_bytes(x, "little") + window for x in done["data"]], np.int32)})

    def suffixes(b: pd.DataFrame, held: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Rows that equal the row before or after; the last row is held with whether it is known to repeat."""
        b = b.assign(known=False) if held is None else pd.concat([held, b.assign(known=False)], ignore_index=True)
        same = ((b["h"] == b["h"].shift()) & (b["data"] == b["data"].shift())).to_numpy()
        hit = b["known"].to_numpy(bool) | same | np.r_[same[1:], False]
        last = b.iloc[[-1]].assign(known=bool(hit[-1]))
        out = b[hit & np.r_[np.ones(len(b) - 1, bool), False]]
        return out, last

    def spans(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rid": b["rid"].to_numpy(), "start": b["first"].to_numpy(np.int32), "stop": b["first"].to_numpy(np.int32) + np.int32(window)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        held: pd.DataFrame | None = None
        for f in frames:
            lone = f[f["kind"] == _SUFFIX]
            if len(lone):
                out, held = suffixes(lone, held)
                yield spans(out)
            rest = f[f["kind"] != _SUFFIX]
            if not len(rest):
                continue
            rest = rest if left is None else pd.concat([left, rest], ignore_index=True)
            open_ = (rest["h"] == rest["h"].iloc[-1]).to_numpy()
            left, rest = rest[open_], rest[~open_]
            ends = np.flatnonzero(np.r_[np.diff(rest["h"].to_numpy()) != 0, True]) + 1 if len(rest) else np.zeros(0, int)
            at = 0
            while at < len(rest):  # whole groups, BUILD suffixes or so at a time
                stop = ends[max(np.searchsorted(ends, at + BUILD // 12, "right") - 1, np.searchsorted(ends, at, "right"))]
                yield from solve(rest.iloc[at:stop])
                at = stop
        if left is not None:
            yield from solve(left)
        if held is not None and held["known"].iloc[0]:
            yield spans(held)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """docs with __rid, and (__rid, __spans): the word intervals [start, stop) that repeated windows cover. docs must have text and the columns that make its key; all its columns travel, so select few."""
    docs = docs.withColumn("__rid", row_key(*docs.columns))
    anchors = stored(docs.select("__rid", "text").mapInPandas(_emit_anchors(window, k), "h long, rid binary, place int"), "anchors")
    often = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")
    hits = joined(anchors, often.select("h", (F.col("n") > group).cast("int").alias("hot")), ["h"], heavy(often, "h")).groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.col("place") * 2 + F.col("hot")).alias("__hits"))
    # Both joins of the texts, this and that with the spans, are outer joins over all columns, so that Spark shuffles the texts once for both.
    stretches = docs.join(hits, "__rid", "left").mapInPandas(_emit_stretches(window, k), "h long, kind int, rid binary, first int, data binary")
    found = stretches.repartition("h").sortWithinPartitions("h", "kind", "data").mapInPandas(_find_repeats(window, k), "rid binary, start int, stop int")
    return docs, found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, group: int = GROUP) -> DataFrame:
    """docs with __n_words, __n_removed and __kept (the kept words, joined by one space)."""
    keyed, spans = repeats(docs, window, k, group)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, gone, kept = [], [], []
            for t, s in zip(f["text"], f["__spans"], strict=True):
                w = words(t)
                n.append(len(w))
                if s is not None and len(s):
                    edge = np.zeros(len(w) + 1, np.int32)
                    np.add.at(edge, [x["start"] for x in s], 1)
                    np.add.at(edge, [x["stop"] for x in s], -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone.append(len(w) - stay.size)
                    w = [w[i] for i in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(w).decode())
            yield f.drop(columns=["__rid", "__spans"]).assign(__n_words=n, __n_removed=gone, __kept=kept)

    schema = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__n_removed": F.lit(0).cast("long"), "__kept": F.lit("")}).schema
    return keyed.join(spans, "__rid", "left").mapInPandas(cut, schema)
