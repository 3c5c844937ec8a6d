import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from waymark.llm import quality_rules as R
from waymark.llm.queries import op5_quality_rules


def plain(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again))


def test_statistics_equal_a_plain_version():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(["a ", "b ", "a b c ", "É", " ", "\n", "\n\n", "* ", "#x ", "ab\n", "\x1c", "\t"]) for _ in range(r.randint(0, 60)))
        assert R.text_statistics(t)[:5] == plain(t), repr(t)
    assert R.text_statistics(None) == (0,) * 7


def plain_vector(t):
    n, chars, symbols, dup, repeated = plain(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1))))
    return [math.log(max(chars, 1) / n), share(symbols, chars), share(dup, lines), share(repeated, n), share(len(re.findall("[A-Z]", t)), chars), math.log(n / max(lines, 1) + 1)]


def plain_estimate(x, seed, starts=30):
    """Minimum covariance determinant from many random starts, in memory."""
    r = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        own = x[r.choice(len(x), 30, replace=False)]
        last = math.inf
        scale = 1.0
        while True:
            mean, cov = own.mean(0), scale * np.cov(own.T, bias=True) + np.diag(np.square(R.FLOORS))
            det = np.linalg.slogdet(cov)[1]
            if last - det < 1e-6 and last < math.inf and scale > 1:
                break
            last, scale = (det if scale > 1 else math.inf), R.CONSISTENT
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[d <= np.sort(d)[math.ceil(R.SHARE * len(x)) - 1]]
        if best is None or det < best[0]:
            best = (det, mean, np.linalg.inv(cov))
    return best


def test_query_equals_plain_statistics_and_a_plain_estimate(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_quality_rules(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in docs.text.items():
        p = plain(t)
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == p
        assert got.loc[i, "base_failed"] == (p[0] < 50 or 100 * p[4] > 50 * p[0])
    assert not got.kept[got.base_failed].any()
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").join(got)
    y = y[~y.base_failed]
    assert y.kept[y.quality == 1].mean() > 0.97 and y.kept[y.quality == 0].mean() < 0.2

    passing = docs[~got.base_failed.loc[docs.index]]
    x = pd.DataFrame([plain_vector(t) for t in passing.text], index=passing.index)
    own = passing.groupby(["lang", "source"], dropna=False)
    distance = pd.Series(0.0, x.index)
    for (lang, _), g in own:
        rows = g.index if len(g) >= R.LEAST else passing.index[passing.lang == lang]
        rows = rows if len(rows) >= R.LEAST else passing.index
        _, mean, inv = plain_estimate(x.loc[rows].to_numpy(), 1)
        d = x.loc[g.index].to_numpy() - mean
        distance[g.index] = np.einsum("ij,jk,ik->i", d, inv, d)
    kept = got.kept.loc[x.index]
    assert (kept == (distance <= R.CUT)).mean() > 0.99
    sure = (distance < 0.8 * R.CUT) | (distance > 1.25 * R.CUT)
    assert (kept[sure] == (distance[sure] <= R.CUT)).mean() > 0.997


def test_estimate_is_robust(spark):
    r = np.random.default_rng(2)
    clean = r.multivariate_normal([1.6, 0, 0.1, 0.2, 0.13, 3.7], np.diag([0.01, 0.01, 0.04, 0.04, 0.01, 0.1]), 1000)
    bad = clean[:200] + [0.8, 0.9, 0, 0, 0.5, 0]
    rows = [("g", i, *map(float, x)) for i, x in enumerate(np.vstack([clean, bad]))]
    df = spark.createDataFrame(rows, "g string, h long, " + ", ".join(f"x{i} double" for i in R._P))
    found = R.estimate(df, spark.createDataFrame([("g", 1200)], "g string, n long"))
    p = found.first()
    assert np.allclose([p[f"m{i}"] for i in R._P], clean.mean(0), atol=0.05)
    d = df.join(found, "g").select(R._distance().alias("d")).toPandas().d.to_numpy()
    assert (d[:1000] < R.CUT).mean() > 0.99 and (d[1000:] > R.CUT).mean() > 0.99


def test_the_start_of_least_determinant_wins(spark):
    """A majority that is no ellipse about the medians: the middle lies between two clouds, of which the larger is the estimate."""
    r = np.random.default_rng(4)
    a, b = r.normal(0, 0.02, (800, 6)), r.normal(0, 0.02, (260, 6)) + [1, 0, 0, 1, 0, 1]
    rows = [("g", i, *map(float, x)) for i, x in enumerate(np.vstack([a, b]))]
    df = spark.createDataFrame(rows, "g string, h long, " + ", ".join(f"x{i} double" for i in R._P))
    p = R.estimate(df, spark.createDataFrame([("g", 1060)], "g string, n long")).first()
    assert np.allclose([p[f"m{i}"] for i in R._P], a.mean(0), atol=0.02)


def test_nulls_small_groups_and_empty_tables(docs_of):
    text = " ".join(f"w{i}" for i in range(80))
    got = R.judge(docs_of([(None, text, None, None), (1, None), (2, ""), (3, text, "de", "x"), (3, text, "de", "x"), (4, "w" * 300_000)])).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert R.judge(docs_of([])).count() == 0


def test_a_small_source_is_judged_by_all_of_its_language(docs_of):
    r = random.Random(6)
    rows = [(i, " ".join(f"{'abcdefgh'[r.randrange(8)] * r.randint(3, 7)}{r.randrange(900)}" for _ in range(200)), "en", "large") for i in range(150)]
    odd = " ".join(f"#*{r.randrange(10**6)}$%&" for _ in range(200))
    rows += [(1000, odd, "en", "lone"), (1001, rows[0][1] + " end", "en", "other")]
    got = {x.doc_id: x for x in R.judge(docs_of(rows)).collect()}
    assert not got[1000].kept and got[1000].distance > R.CUT
    assert got[1001].kept and sum(got[i].kept for i in range(150)) > 145
