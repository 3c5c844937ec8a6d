"""The automaton against a backtracking matcher, and the rules against a plain reading of the contract."""

import random
import re

import duckdb
import numpy as np

from waymark.llm import url_filters as U
from waymark.llm.oracles import ORACLES
from waymark.llm.queries import QUERIES


def as_regex(pattern):
    parts = re.split(r"(\*+|\?)", pattern)
    return re.compile("".join("[^/]*" if p == "*" else ".*" if p.startswith("**") else "[^/]" if p == "?" else re.escape(p) for p in parts), re.S)


def test_the_automaton_equals_a_backtracking_matcher():
    r = random.Random(5)
    pick = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    patterns = ["", "*", "**", "?", "a", *{pick("ab/.*?é", 9) for _ in range(150)}]
    patterns = [p for p in patterns if not re.search(r"\*{3}", p)]
    urls = ["", "/", *(pick("ab/.é漢", 12) for _ in range(300))]
    got = U.matches(U.compiled([U.tokens(p) for p in patterns]), urls)
    want = np.array([[bool(as_regex(p).fullmatch(u)) for p in patterns] for u in urls])
    assert (got == want).all() and want.any() and not want.all()


def plain(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fit = [r for r in U.RULES if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    if best:
        return host, path, best[1] + best[2], best[0]
    held = [(sum(c not in "*?" for c in g), v) for v, g in U.GLOBS if as_regex(g).fullmatch(host + path)]
    top = [v for n, v in held if n == max(held)[0]]
    return host, path, None, "allow" if not top or "block" not in top else "block"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "https://a.b.Example.org/es/1?q=/de/", "https://example.org/en/1", "https://example.org/en/2",
    "https://badexample.org/es/1", "http://x.com/de/", "http://x.com/fr/", "http://x.com/a.com/de/", "http://x.net/a.org/", "http://com", "http://com/de/#x", "http://u:p@x.com:80/de/",
    "http://x.casino-win.net/a", "http://casino-win.net", "http://x.net/robots.txt", "http://x.net/a/robots.txt", "http://cheap-pills.net/robots.txt", "http://ads-t.net/x", "http://x.net/a.exe", "a://b://c.org/x",
    "http://é.org/ü", "http://x.net/" + "y" * 70_000, "http://x.net/" + "y" * 70_000 + ".zip", "http://x.org/a\nb", "HTTP://X.NET/CART/", "http://x.net/cart/",
]


def test_rules_globs_and_awkward_rows(spark, tmp_path):
    rows = [(i, u, "h", 1.5, None) for i, u in enumerate([*URLS, URLS[7]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict double, glob array<int>")
    got = {r["page_id"]: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in U.judged(df).collect()}
    assert got == {i: plain(u) for i, u, *_ in rows}
    assert U.judged(df).columns[:5] == df.columns and U.judged(df).dtypes[:5] == df.dtypes
    assert U.judged(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    q = QUERIES["op11_url_filters"](spark, str(tmp_path))
    want = c.sql(f"SELECT {', '.join(q.columns)} FROM ({ORACLES['op11_url_filters']})").fetchall()
    assert sorted(map(tuple, q.collect()), key=str) == sorted(want, key=str)


def test_other_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/x?y"), (2, "http://b.c/*"), (3, "http://b.c/")], "page_id long, url string")
    rules = (("block", "b.c", "/"), ("allow", "a.b.c", "/"), ("allow", "b.c", "/*"))
    assert [r["__verdict"] for r in U.judged(df, rules, ()).orderBy("page_id").collect()] == ["allow", "allow", "block"]
    assert [r["__verdict"] for r in U.judged(df, (), (("block", "?.?.?/?"),)).orderBy("page_id").collect()] == ["block", "allow", "allow"]
