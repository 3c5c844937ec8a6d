"""Operator 4: main-text extraction with host suffix arrays.

A page is cut into blocks of text in page order. Blocks inside the article or main element are main text; where there
is none, those in a part whose class, id or role names it the article; but blocks inside chrome (menus, page headers,
footers, sidebars, notices, adverts, forms, comments, by element, class, id or role) never are. What is chrome by name,
or a form, but holds the article does not count for it. All other text of a page with neither is open: its host decides.

The host's evidence is the token stream of each of its pages, which is all text but what markup proves to be the
article. Pages with equal streams are one page, so a copied page is not boilerplate. The streams of a host are
concatenated, in parts of some GROUP tokens, and a suffix array orders the suffixes of a part by their first LENGTH
tokens; its intervals of equal prefixes count the distinct pages of each substring. Every page is in one part, so the
counts of a substring's intervals add up to its exact number of distinct pages on the whole host, however large: a
part is a unit of memory and changes no result. A substring of LENGTH tokens on MIN_PAGES distinct pages or more is
boilerplate, as is every longer one made of such. Open tokens that it covers go, the unique runs stay.

Markup alone decides where it speaks, because the arrays alone can be wrong there: adverts that occur on few pages do
not repeat, and passages that many articles share do.

Defined results: a null html is the empty page with an empty text; a null url is a host of its own, as is the lack of
one; repeated rows get equal results; a page that is cut off ends where it ends; the parser reads a page once, so a
very long page takes time and memory in proportion; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import heavy, joined, row_key, stored

LENGTH, MIN_PAGES, GROUP = 6, 3, 200_000
MAIN, OPEN, CHROME, NAMED = 0, 1, 2, 3

#: Possessive throughout, so that no page makes it try again what it has read.
_SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|iframe|object|select|(?:svg|math)(?!(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?<=/)>))(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHROME_WORD = (
    r"(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|side-?bar|menu|nav|navbar|navigation|bread-?crumbs?|masthead|cookies?|consent|notice|alert|pop-?up|modal|newsletter|subscribe"
    r"|related|share|sharing|social|comments?|disqus|widget|login|signup|complementary|contentinfo|search|toolbar|dialog)"
)
#: Only whole names count: a chrome word, alone or with words that say nothing else. Inside the article ids say nothing.
_NEUTRAL = r"(?:area|author|bar|block|blocks|body|bottom|box|button|buttons|container|content|form|icons|inline|inner|item|items|left|links|list|meta|outer|page|panel|post|posts|reader|right|section|site|small|stories|text|the|thread|top|user|wrap|wrapper)"
_CHROME_WHOLE = re.compile(rf"(?:^|\s)(?:{_NEUTRAL}[_-]+)*{_CHROME_WORD}(?:[_-]+(?:{_NEUTRAL}|{_CHROME_WORD}))*(?:$|\s)", re.I)
#: Words that name a section of the article that is none of its text; others, such as search or menu, may be what the section is about.
_SECTION_WHOLE = re.compile(rf"(?:^|\s)(?:{_NEUTRAL}[_-]+)*(?:ad|ads|advert\w*|sponsor\w*|promo\w*|side-?bar|newsletter|subscribe|related|share|sharing|comments?|disqus|cookies?|bread-?crumbs?)(?:[_-]+(?:{_NEUTRAL}|{_CHROME_WORD}))*(?:$|\s)", re.I)
_HEADING = frozenset(f"h{i}" for i in range(1, 7))
#: Chrome around the article; inside it a header or footer of this name is part of the article's own frame.
_FRAME_NAME = re.compile(r"(?:^|[\s_-])(?:page-?header|site-?header|header|foot|footer|top-?bar)(?:$|[\s_-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|\s)(?:main|content|article|post|entry|story)(?:[_-]?(?:body|content|text|main))?(?:$|\s)", re.I)
_CHROME_TAG = frozenset("nav footer aside form menu dialog button".split())
_MAIN_TAG = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_EMPTY = frozenset("svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"caption", "figcaption", "legend", "option", "summary"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(MAIN, OPEN or CHROME; text) of each block that has text, in page order. Where a page has main text, no block of it is open.

    Forms and parts named like chrome are chrome themselves, but not for an article that they hold: of several articles
    those that the fewest of them wrap are main text. Chrome within a line of text drops its words and ends no block.
    """
    out: list[tuple[int, int, bool, str]] = []
    text: list[str] = []
    stack: list[tuple] = []
    #: In chrome, in chrome within a line, in article or main, in an article, in a part named so, in chrome that holds no article, wrappers that are chrome by name or a form.
    start = (False, False, False, False, False, False, 0)
    chrome, quiet, inside, deep, named, hard, wraps = start
    html = html or ""

    def flush() -> None:
        if text:
            if t := " ".join(unescape("".join(text)).split()):
                out.append((CHROME if chrome else MAIN if inside else NAMED if named else OPEN, wraps, deep, t))
            text.clear()

    at = 0
    end = html.rfind(">") + 1  # beyond it no tag ends
    for m in _SPLIT.finditer(html, 0, end):
        if m.start() > at and not quiet:
            text.append(html[at : m.start()])
        at = m.end()
        if at == end and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*+>\Z", m[0], re.I)):
            at = len(html)  # what is not closed goes on to the end
        if m[1]:
            if m[1].lower() != "title":
                text.append(" ")
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag in _EMPTY and not (m[2] or m[5]):  # self-closed, or _SPLIT would have taken the element
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            text.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if m[2] or m[5]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            # An end tag of running text closes nothing beyond the block that it is in.
            if k >= 0 and (block or not any(s[0] in _BLOCK for s in stack[k + 1 :])):
                del stack[k:]
        else:
            if tag in _ENDS_P:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), -1)
                if k >= 0 and (stack[k][0] == "p" or stack[k][0] in _SELF.get(tag, ())):
                    del stack[k:]
            _, chrome, quiet, inside, deep, named, hard, wraps = stack[-1] if stack else ("", *start)
            found = _NAMES.findall(m[4] or m[7] or "") if (m[4] or m[7]) else []
            names = " ".join(a or b or c for _, a, b, c in found)
            main = tag in _MAIN_TAG
            if inside or named:
                own = " ".join(a or b or c for k, a, b, c in found if k.lower() != "id") if tag not in _HEADING else ""
                by_name = bool(own and not main and (_SECTION_WHOLE if tag == "section" else _CHROME_WHOLE).search(own))
            else:
                by_name = bool(names and not main and tag not in ("html", "body") and (_CHROME_WHOLE.search(names) or _FRAME_NAME.search(names)))
            by_tag = tag in _CHROME_TAG and tag != "form" or (tag == "header" and not inside) or tag == "head"
            soft = by_name or tag == "form"
            part = named or tag in ("div", "section", "td") and bool(_MAIN_NAME.search(names)) and not by_name
            hard = hard or by_tag or deep and soft or by_name and "comment" in names.lower()
            wraps += soft and not deep
            if block:
                # An article, or where nothing is one a part named so, is not chrome for what merely wraps it.
                chrome, quiet = hard or (chrome or quiet or soft) and not (main or part and not named), False
            else:
                quiet = not chrome and (quiet or soft or by_tag)
            stack.append((tag, chrome, quiet, inside or main, deep or tag == "article", part, hard, wraps))
        _, chrome, quiet, inside, deep, named, hard, wraps = stack[-1] if stack else ("", *start)
    if at < len(html) and not quiet:
        text.append(html[at:])
    flush()
    found = {k for k, *_ in out}
    own = MAIN if MAIN in found else NAMED
    if own in found:
        articles = [w for k, w, d, _ in out if k == own and d] or [w for k, w, _, _ in out if k == own]
        least = min(articles)
        return [(MAIN if k == own and (w == least or not d and w < least) else CHROME, t) for k, w, d, t in out]
    return [(k, t) for k, *_, t in out]


def _stream(found: list[tuple[int, str]]) -> list[str]:
    """The tokens of the blocks that are not main text, each block ended by a line feed."""
    return [w for k, t in found if k != MAIN for w in (*t.split(" "), "\n")]


def ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix in a suffix array ordered by the first `length` tokens: prefixes are doubled until they are as long."""
    rank, size, n = tokens.astype(np.int64), 1, tokens.size
    while size < length:
        step = min(size, length - size)
        after = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        rank = np.unique(rank * (after.max(initial=0) + 1) + after, return_inverse=True)[1]
        size += step
    return rank


def intervals(streams: list[list[str]], length: int = LENGTH) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """From the suffix array of these streams: the distinct substrings of `length` tokens, and on how many of the streams each occurs."""
    flat = [w for i, s in enumerate(streams) for w in (*s, f"\n{i}")]  # each stream has an end of its own
    n = len(flat)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    whole = np.flatnonzero(page[: n - length] == page[length:]) if n > length else np.zeros(0, np.int64)  # the end is no token of a substring
    if not whole.size:
        return [], np.zeros(0, np.int64)
    rank = ranks(pd.factorize(np.array(flat, object))[0], length)[whole]
    order = np.lexsort((page[whole], rank))
    r, p = rank[order], page[whole][order]
    new = np.r_[True, r[1:] != r[:-1]]
    heads = np.flatnonzero(new)
    n_pages = np.add.reduceat((new | np.r_[True, p[1:] != p[:-1]]).astype(np.int64), heads)
    return [tuple(flat[i : i + length]) for i in whole[order[heads]]], n_pages


def _code(host: str, window: tuple[str, ...]) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(host)}:{host} {' '.join(window)}".encode("utf-8", "surrogatepass"))


def token_streams(pages: DataFrame) -> DataFrame:
    """(__rid, host, stream, n, open) of each page that has text outside its proven article: the stream's tokens joined by spaces, and whether any is open."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r, host, h in zip(f["__rid"], f["host"], f["html"], strict=True):
                found = blocks(h)
                if s := _stream(found):
                    rows.append((r, host, " ".join(s), len(s), any(k == OPEN for k, _ in found)))
            yield pd.DataFrame(rows, columns=["__rid", "host", "stream", "n", "open"])

    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return pages.select("__rid", host.alias("host"), "html").mapInPandas(parse, "__rid binary, host string, stream string, n long, open boolean")


def repeated_substrings(streams: DataFrame, length: int = LENGTH, min_pages: int = MIN_PAGES, group: int = GROUP) -> DataFrame:
    """(code, n): the substrings of `length` tokens on min_pages distinct streams of a host or more, counted over the whole host."""
    own = streams.select("host", "stream", "n").dropDuplicates(["host", "stream"])
    sizes = stored(own.groupBy("host").agg(F.ceil(F.sum("n") / group).alias("parts"), F.count(F.lit(1)).alias("n")), "hosts")
    placed = joined(own.drop("n"), sizes.select("host", "parts"), ["host"], heavy(sizes, "host"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        found, n = intervals([s.split(" ") for s in f["stream"]], length)
        return pd.DataFrame({"code": [_code(f["host"].iloc[0], w) for w in found], "n": n})

    each = placed.groupBy("host", F.pmod(F.xxhash64("stream"), F.col("parts")).alias("part")).applyInPandas(solve, "code binary, n long")
    return each.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)


def boilerplate(pages: DataFrame, length: int = LENGTH, min_pages: int = MIN_PAGES, group: int = GROUP) -> DataFrame:
    """(__rid, __gone): of each page with open blocks, the places in its stream that its host's repeated substrings cover. Only hosts that have open blocks build arrays."""
    streams = stored(token_streams(pages), "streams")
    asked = stored(streams.where("open").select("host").distinct(), "hosts-asked")
    some = asked.count()  # no open text, no question
    often = stored(repeated_substrings(streams.join(asked, "host", "left_semi") if some else streams.limit(0), length, min_pages, group), "substrings")

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r, host, s in zip(f["__rid"], f["host"], f["stream"], strict=True):
                w = s.split(" ")
                rows += [(r, i, _code(host, tuple(w[i : i + length]))) for i in range(len(w) - length + 1)]
            yield pd.DataFrame(rows, columns=["__rid", "at", "code"])

    own = streams.where("open").select("__rid", "host", "stream").dropDuplicates(["__rid"]).mapInPandas(places, "__rid binary, at int, code binary")
    hit = joined(own, often.select("code"), ["code"], heavy(often, "code"))
    return hit.groupBy("__rid").agg(F.collect_set("at").alias("__gone"))


def main_text(html: str | None, gone=(), length: int = LENGTH) -> str:
    """The text of the main blocks, and of the open ones without what the repeated substrings starting at the places `gone` of the page's stream cover."""
    found = blocks(html)
    if gone is None or not len(gone):
        return "\n\n".join(t for k, t in found if k != CHROME)
    away = {i + j for i in map(int, gone) for j in range(length)}
    at, out = 0, []
    for k, t in found:
        if k == MAIN:
            out.append(t)
            continue
        w = t.split(" ")
        if k == OPEN and (rest := [x for i, x in enumerate(w, at) if i not in away]):
            out.append(" ".join(rest))
        at += len(w) + 1
    return "\n\n".join(out)


def extract(pages: DataFrame, length: int = LENGTH, min_pages: int = MIN_PAGES, group: int = GROUP) -> DataFrame:
    """(page_id, url, text) of each page."""
    keyed = pages.select(row_key("page_id", "url", "html").alias("__rid"), "page_id", "url", "html")
    gone = stored(boilerplate(keyed, length, min_pages, group), "boilerplate")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["page_id", "url"]].assign(text=[main_text(h, g, length) for h, g in zip(f["html"], f["__gone"], strict=True)])

    kinds = dict(pages.dtypes)
    return keyed.join(gone, "__rid", "left").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string")
