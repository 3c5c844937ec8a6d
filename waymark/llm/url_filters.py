"""Operator 11: URL filters by a bit-parallel wildcard automaton.

All patterns are simulated at once over a canonical URL (host, A-Z lower-cased, then path). Each has a run of bits in
a row of 64-bit words, one more than it has characters: bit j of the run is set while the URL read so far matches the
pattern's first j characters. A character c takes the words D to ((D << 1) & STEP[c]) | (D & STAY[c]), the shift
carried from word to word: STEP[c] has the bits that c leads to (never a run's first bit, so no pattern leaks into the
next), STAY[c] the bits in front of a wildcard that takes c. A pattern matches if its last bit is set at the URL's end.
All URLs of an Arrow batch advance together, longest first, so that those that have ended drop off.

Patterns: * stands for any run of characters but /, ** for any run, ? for one character but /; all others for
themselves. A rule (host, path) is two patterns, for the host itself and for its subdomains: host + path + ** and
*. + host + path + **. The longest rule that fits decides; of equal ones that with the longer host, then block. Where
no rule fits the pattern with the most characters besides wildcards does, of equal ones block, and allow where none
matches. One table of words of (characters used + 2) rows goes to every task; its size follows from the patterns, which
are parameters.

Defined results: a null url, or one without ://, has an empty host and path, and is judged by patterns that match the
empty text, if any; repeated rows are judged each; a very long url costs a step a character; other columns stay, names
that begin with __ are this operator's; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules of the contract as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What decides where no rule fits: gambling, pills and trackers by host, and paths that hold no text.
GLOBS = (
    ("block", "**casino-*/**"), ("block", "**free-bets*/**"), ("block", "**cheap-pills*/**"), ("block", "ads-*/**"), ("block", "*.ads-*/**"),
    ("block", "**/wp-admin/**"), ("block", "**/cart/**"), ("block", "**.exe"), ("block", "**.zip"), ("allow", "*/robots.txt"),
)
_ONE = np.uint64(1)


class Automaton(NamedTuple):
    """letters: the characters that have a row of their own, in order; the last row is that of all others."""

    letters: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: np.ndarray


def tokens(pattern: str) -> list[tuple[str, str]]:
    """(character or ?, wildcard in front of it) of each; the last has no character."""
    out, before, i = [], "", 0
    while i < len(pattern):
        if pattern[i] == "*":
            wide = pattern[i : i + 2] == "**"
            before = "**" if wide or before == "**" else "*"
            i += 1 + wide
        else:
            out.append((pattern[i], before))
            before, i = "", i + 1
    return [*out, ("", before)]


def of_rule(host: str, path: str) -> list[list[tuple[str, str]]]:
    """The two patterns of a rule, whose characters stand for themselves."""
    own = [("\\" + c if c in "?" else c, "") for c in host + path] + [("", "**")]
    return [own, [(".", "*"), *own]]


def compiled(runs: list[list[tuple[str, str]]]) -> Automaton:
    letters = sorted({c[-1] for run in runs for c, _ in run if c and c != "?"} | {"/"})
    row = {c: i for i, c in enumerate(letters)}
    slash = row["/"]
    words = (sum(map(len, runs)) + 63) // 64 or 1
    step, stay = np.zeros((2, len(letters) + 1, words), np.uint64)
    start, final, at = np.zeros(words, np.uint64), [], 0
    for run in runs:
        start[at // 64] |= _ONE << np.uint64(at % 64)
        for c, before in run:
            word, bit = at // 64, _ONE << np.uint64(at % 64)
            if before:
                stay[:, word] |= bit
                if before == "*":
                    stay[slash, word] &= ~bit
            if c:
                word, bit = (at + 1) // 64, _ONE << np.uint64((at + 1) % 64)
                if c == "?":
                    step[:, word] |= bit
                    step[slash, word] &= ~bit
                else:
                    step[row[c[-1]], word] |= bit
            at += 1
        final.append(at - 1)
    return Automaton(np.array([ord(c) for c in letters], np.uint32), step, stay, start, np.array(final, np.int64))


def matches(a: Automaton, urls: list[str]) -> np.ndarray:
    """Which patterns match which urls, one row a url."""
    points = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) for u in urls]
    size = np.array([p.size for p in points], np.int64)
    order = np.argsort(-size, kind="stable")
    text = np.concatenate([points[i] for i in order]) if len(urls) else np.zeros(0, np.uint32)
    found = np.minimum(np.searchsorted(a.letters, text), a.letters.size - 1)
    rows = np.where(a.letters[found] == text, found, a.letters.size)
    long, first = size[order], np.r_[0, np.cumsum(size[order])[:-1]].astype(np.int64)
    d = np.tile(a.start, (len(urls), 1))
    for j in range(int(long[0]) if len(urls) else 0):
        n = int(np.searchsorted(-long, -j))
        c, now = rows[first[:n] + j], d[:n]
        moved = now << _ONE
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        d[:n] = (moved & a.step[c]) | (now & a.stay[c])
    out = np.zeros((len(urls), a.final.size), bool)
    out[order] = (d[:, a.final // 64] >> (a.final % 64).astype(np.uint64)) & _ONE
    return out


def host_and_path(url: str) -> tuple[Column, Column]:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased, and on to ?, # or the end; both empty without ://."""
    rest = F.coalesce(F.when(F.col(url).contains("://"), F.substr(F.col(url), F.locate("://", F.col(url)) + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: tuple = RULES, globs: tuple = GLOBS, url: str = "url") -> DataFrame:
    """pages with __host, __path, __rule (host + path of the rule that decided, or null), __glob (the pattern that decided, or null) and __verdict, allow or block."""
    by_rule = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    by_glob = sorted(globs, key=lambda g: (-sum(bool(c) and c != "?" for c, _ in tokens(g[1])), g[0] != "block"))
    automaton = compiled([*(run for _, host, path in by_rule for run in of_rule(host, path)), *(tokens(g) for _, g in by_glob)])
    # What each pattern says, in order of precedence, and last what holds where none matches.
    says = [(host + path, None, verdict) for verdict, host, path in by_rule for _ in range(2)] + [(None, g, verdict) for verdict, g in by_glob] + [(None, None, "allow")]
    rule, glob, verdict = (np.array(x, object) for x in zip(*says, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [h + p for h, p in zip(b["__host"].to_pylist(), b["__path"].to_pylist(), strict=True)]
            first = np.c_[matches(automaton, urls), np.ones(len(urls), bool)].argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[first], pa.string()) for x in (rule, glob, verdict))], names=[*b.schema.names, "__rule", "__glob", "__verdict"])

    host, path = host_and_path(url)
    canonical = pages.withColumns({"__host": host, "__path": path})
    added = T.StructType([T.StructField(n, T.StringType()) for n in ("__rule", "__glob", "__verdict")])
    return canonical.mapInArrow(run, T.StructType([*canonical.schema, *added]))
