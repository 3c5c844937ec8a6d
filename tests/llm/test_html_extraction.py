import random
import re
from collections import Counter
from html import unescape

import numpy as np

from waymark.llm import html_extraction as H


def test_markup_decides():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Site &amp; logo</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>A &lt;title&gt;</h1></header><p>One <b>bold<p>Two
      lines &copy; &#8364;<br>end</p><aside>side</aside><form>q</form><div class='comments'><p>reader</p></div><ul><li>x<li>y</ul></article>
    <div id=sidebar>links</div><footer>&copy; me</footer>"""
    assert H.main_text(page) == "A <title>\n\nOne bold\n\nTwo lines © € end\n\nx\n\ny"


def test_names_decide_where_no_element_does():
    page = """<div class="site-header">Logo</div><div class="top-menu">a b</div><div id="content"><div class="post-header"><h1>Title</h1></div><p>Text</p><div class="share">x</div><div class="user-comments">y</div></div><div class="footer">z</div><div>teaser</div>"""
    assert H.main_text(page) == "Title\n\nText"
    assert H.main_text("<div class=content>teaser</div><article><div class='article-header'>T</div><p>body</p></article>") == "T\n\nbody"


def test_broken_pages():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<p") == "<p"
    assert H.main_text("<article><p>a<script>no end") == "a"
    assert H.main_text("<article><p title='>'>a</p><!-- x > y --><p>b < c</p>") == "a\n\nb < c"
    assert H.main_text("<main><div><span>a</div>b</span></main>after") == "a\n\nb"
    assert len(H.main_text("<article>" + "<p>word</p>" * 50_000)) == 6 * 50_000 - 2
    assert H.main_text("<article><p>" + "x'\"=<" * 2000) != ""
    assert H.main_text("<article><p>kept</p><span class=ad>gone</span> on</article>") == "kept\n\non"


def test_wrappers_do_not_take_the_article():
    article = "<article><p>a</p></article>"
    for names in ("layout has-sidebar", "no-sidebar", "with-menu", "sidebar", "menu", "page search"):
        assert H.main_text(f'<div class="{names}">{article}</div>') == "a", names
    assert H.main_text(f"<form id=aspnetForm>{article}<input></form>") == "a"
    assert H.main_text(f"<form><div class=sidebar><article>card</article></div>{article}<footer>f</footer></form>") == "a"
    assert H.main_text(f"<aside><article>card</article></aside><div class=ads><article>card</article></div>{article}") == "a"
    assert H.main_text(f"<main><h1>t</h1><div class=menu>{article}</div><div class=comments><article>me</article></div></main>") == "t\n\na"
    assert H.main_text(f"<main>{article}<div class=related><article>card</article></div></main>") == "a"
    assert H.main_text("<form><div class=content><p>a</p><form>q</form><div class=share>x</div></div></form>") == "a"
    assert H.main_text("<article><section class='search'><h2>Search</h2><p>binary search</p></section><section class=related><p>x</p></section></article>") == "Search\n\nbinary search"


def test_chrome_within_a_line_ends_no_block():
    assert H.main_text("<article><p>a <a class='share'>w</a> b</p></article>") == "a b"
    assert H.main_text("<article><p>a<span class=ad>w <b>x</b></span>b <button>y</button>c</p></article>") == "ab c"
    assert H.main_text("<article><p>a</p>b <span class=ad>w<div>x</div>y</span> c</article>") == "a\n\nb\n\nc"
    assert H.main_text("<article><div class='comment-body'>x</div><div class='comment-list'><p>x</p></div><p>a</p></article>") == "a"


def test_made_pages_give_the_blocks_that_they_were_made_of():
    r = random.Random(12)
    word = lambda: r.choice(["alpha", "b&amp;c", "d &lt; e", "<b>bold</b>", "<em>f</em>g", "menu", "share", "&eacute;"])
    plain = lambda t: " ".join(unescape(re.sub("<[^>]*>", "", t)).split())
    inline = ["<a class=share>tweet</a>", "<span class='ad'>buy</span>", "<button>ok</button>", "<span class='share-buttons'><i>x</i></span>"]
    chrome = ["<nav><p>home</p></nav>", "<aside>links</aside>", "<div class='user-comments'><p>first!</p></div>", "<div class='comment-body'>me too</div>", "<form><p>mail</p></form>", "<div class='cookie-notice'>we use</div>", "<ul class='share-links'><li>x</ul>"]
    for _ in range(300):
        want, body = [], []
        for _ in range(r.randint(1, 6)):
            words = [word() for _ in range(r.randint(1, 8))]
            want.append(plain(" ".join(words)))
            if r.random() < 0.4:
                words.insert(r.randint(0, len(words)), r.choice(inline))
            tag = r.choice(["p", "h2", "li", "blockquote", "div"])
            body.append(f"<{tag}>{' '.join(words)}</{tag}>" + (r.choice(chrome) if r.random() < 0.4 else ""))
        page = f"<article>{''.join(body)}</article>"
        for _ in range(r.randint(0, 3)):
            page = r.choice(["<form id=f>{}</form>", "<div class='has-sidebar'>{}</div>", "<div class='menu'>{}</div>", "<div id=search>{}</div>", "<section>{}</section>", "<main>{}</main>", "<div class=page-banner>{}</div>"]).format(page)
            page = r.choice(["{}", "<nav>top</nav>{}", "{}<footer>end</footer>", "<div class=sidebar><p>x</p></div>{}"]).format(page)
        assert H.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(want), page


def test_names_that_begin_like_dropped_elements_and_self_closed_ones():
    assert H.main_text("<article><p>a <svg-icon name=x></svg-icon> b</p><p>c</p></article>") == "a b\n\nc"
    for tag in ("object-x", "select-box", "title-bar", "math-field"):
        assert H.main_text(f"<article><p>a <{tag}>k</{tag}> b</p><p>c</p></article>") == "a k b\n\nc"
    assert H.main_text("<article><p>a<svg class='menu' d=\"x>y\" />b</p><math/><p>c</p></article>") == "a b\n\nc"
    assert H.main_text("<article><p>a<svg><path d='x'/>k</svg>b <SVG x=1>m</SVG\n> c</p></article>") == "a b c"
    assert H.main_text("<article><p>a</p><svg/>") == "a"


def test_names_inside_the_article_are_whole_classes_or_roles():
    kept = "<h2 id=search-trees>a</h2><section id='related-work'><p>b</p></section><div id=social-history>c</div><p class='notice-period'>d</p><h3 class=comments>e</h3>"
    assert H.main_text(f"<article>{kept}</article>") == "a\n\nb\n\nc\n\nd\n\ne"
    gone = "<div class='share-buttons'>x</div><p class='box related'>x</p><div role=search>x</div><div class='reader-comments'>x</div><div class='ad'>x</div>"
    assert H.main_text(f"<article>{gone}<p>y</p></article>") == "y"


def test_given_pages_equal_a_plain_extraction():
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.search("<article>(.*)</article>", html, re.S)[1]
        parts = [re.sub("<[^>]*>", "", re.sub("<br>", " ", x)) for x in re.split("</?(?:p|h1)>", article)]
        assert H.main_text(html) == "\n\n".join(t for x in parts if (t := " ".join(unescape(x).split())))


def test_intervals_equal_brute_force():
    r = random.Random(3)
    menu, foot = [f"m{i}" for i in range(9)] + ["\n"], [f"f{i}" for i in range(7)] + ["\n"]
    pages = [menu + [r.choice("abcdefgh") for _ in range(r.randint(0, 30))] + ["\n"] + (foot if i % 2 else []) for i in range(24)] + [["a"], ["b"] * H.LENGTH, ["b"] * 9]
    found, n = H.intervals(pages)
    want = Counter(w for s in pages for w in {tuple(s[i : i + H.LENGTH]) for i in range(len(s) - H.LENGTH + 1)})
    assert dict(zip(found, n.tolist(), strict=True)) == want and len(found) == len(want)
    for n in (1, 2, 3, 6, 8):
        x = [r.randrange(3) for _ in range(200)]
        rank = H.ranks(np.array(x), n)
        keys = [tuple(x[i : i + n]) for i in range(200)]
        assert all((rank[i] < rank[j]) == (keys[i] < keys[j]) for i in range(0, 200, 7) for j in range(200))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text int")


def test_hosts_decide_what_markup_leaves_open(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i in range(40):
        own = " ".join(f"w{r.randrange(900)}" for _ in range(40))
        url = f"https://h{i % 2}.example.com/{i}" if i % 5 else None
        menu = f"<div><a>home page of {url and url[8:10]}</a> <a>news</a> <a>sport</a> <a>contact us now</a></div>"
        rows.append((i, url, f"<body>{menu}<div><p>{own}</p></div></body>", 0))
        want[i] = own
    rows += [(100, "https://h1.example.com/x", rows[1][2], 0), (101, "https://h1.example.com/y", "<article><p>home page of h1 news sport contact us now</p></article><div>z</div>", 0), (102, None, None, 0), (None, "https://h1.example.com/z", "", 0)]
    for group in (200_000, 400, 1):  # a part is a unit of memory: counts go over the whole host
        got = {x["page_id"]: x["text"] for x in H.extract(pages_of(spark, rows), group=group).collect()}
        assert {i: got[i] for i in want} == want and got[100] == want[1]
        assert got[101] == "home page of h1 news sport contact us now" and got[102] == "" and got[None] == ""
    off = {x["page_id"]: x["text"] for x in H.extract(pages_of(spark, rows), min_pages=1000).collect()}
    assert all(off[i] == f"home page of {r_[1] and r_[1][8:10]} news sport contact us now\n\n{want[i]}" for i, r_ in enumerate(rows[:40]))


def test_a_notice_on_few_pages_of_a_large_host_goes_as_on_a_small_one(spark):
    r = random.Random(6)
    rows, want = [], {}
    for i in range(400):
        own = " ".join(f"w{r.randrange(9000)}" for _ in range(30))
        note = "<div>this section closes at noon on public holidays</div>" if i % 100 == 0 else ""
        rows.append((i, "https://large.example.com/", f"{note}<div>{own}</div>", 0))
        want[i] = own
    got = {x["page_id"]: x["text"] for x in H.extract(pages_of(spark, rows), group=500).collect()}
    assert got == want


def test_long_pages_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "u", "<article>" + "<p>word</p>" * 200_000 + "</article>", 1, 2, "x")], "page_id long, url string, html string, text int, n int, host string")
    assert len(H.extract(d).first()["text"]) == 6 * 200_000 - 2


def test_empty_and_repeated(spark):
    rows = [(1, "https://h1.example.com/1", "<div>a</div>", 0)]
    assert H.extract(pages_of(spark, [])).count() == 0
    assert H.extract(pages_of(spark, rows * 2)).count() == 2
