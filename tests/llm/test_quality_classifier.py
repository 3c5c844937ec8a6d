import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from waymark.llm import quality_classifier as Q
from waymark.llm.queries import op3_quality_classifier

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = score.rank()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    got = op3_quality_classifier(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    y = y[y.held_out]
    assert auc(y.score, y.quality) > 0.95 and (y.predicted == y.quality).mean() > 0.93


def test_vote_equals_brute_force():
    r = np.random.default_rng(0)
    z, known = Q._unit(r.standard_normal((20, 8))), Q._unit(r.standard_normal((50, 8)))
    y = r.integers(0, 2, 50).astype(float)
    got = Q.vote(z, known, y, 7, 2)
    for i in range(20):
        near = sorted(range(50), key=lambda k: -(z[i] @ known[k]))[:7]
        w = np.maximum([z[i] @ known[k] for k in near], 1e-6) ** 2
        assert abs(got[i] - (w * y[near]).sum() / w.sum()) < 1e-9


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, docs_of):
    texts = [(i, ("good words here " * 20 if i % 2 else "BAD!! STUFF!! *** ") * (1 + i % 3), "en", f"s{i % 3}") for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if __import__("zlib").crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r["doc_id"], r["__score"]) for r in Q.score(docs_of(texts), spark.createDataFrame(x, schema)).collect()) for x in (labels, flipped))
    assert a == b
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in a)


def test_nulls_empty_and_long_texts_and_empty_tables(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (5, 7, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(docs_of([(None, None), (1, ""), (2, "\n \t"), (3, "w " * 200_000), (5, "\x00 É 1"), (5, "\x00 É 1")]), labels).collect()
    assert len(got) == 6 and all(0 <= r["__score"] <= 1 for r in got)
    assert Q.score(docs_of([]), labels).count() == 0
    assert Q.score(docs_of([(1, "a")]), labels.limit(0)).first()["__score"] == 0.5
    some = Q.sampled(docs_of([(i, f"w{i}") for i in range(300)] + [(0, "again")] * 200), spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(0, 1, 0)] * 9, "doc_id long, quality int, toxic int"), sample=50)
    assert some.count() == 50


def plain_row(text):
    """The terms of a text, written anew from the docstring of the module."""
    style, word = np.zeros(Q.STYLE), np.zeros(Q.WORDS)
    code = lambda name, n: xxhash.xxh64_intdigest(name.encode()) % n
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    if not w:
        style[code("no words", Q.STYLE)] = 1
        return np.r_[style, word]
    for x in w:
        shape = "".join(k for k, _ in itertools.groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in x))[:8]
        style[code(shape, Q.STYLE)] += 1 / len(w)
    for x, n in Counter(w).items():
        word[xxhash.xxh64_intdigest(x.encode().lower()) % Q.WORDS] += math.log1p(n)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    style[code("same as before", Q.STYLE)] += sum(a == b for a, b in itertools.pairwise(w)) / len(w)
    style[code("repeated triples", Q.STYLE)] += sum(n for n in triples.values() if n > 1) / len(w) if len(w) > 2 else 0
    style[code("repeated lines", Q.STYLE)] += 1 - len(set(lines)) / len(lines)
    style[code(f"line of {min(12, int(math.log2(len(w) / len(lines) + 1)))}", Q.STYLE)] += 1
    style[code(f"text of {min(14, int(math.log2(len(w) + 1)))}", Q.STYLE)] += 1
    return np.r_[np.sqrt(style), word]


def plain_scores(docs, labels):
    """Terms, weights, decomposition and vote over again, in double precision and with a decomposition of another kind."""
    x = np.array([plain_row(t) for t in docs.text])
    y = docs.merge(labels, on="doc_id", how="left").quality.to_numpy()
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in docs.doc_id]) & np.isin(y, (0, 1))
    assert 20 < learn.sum() < Q.SAMPLE
    idf = np.minimum(np.log((1 + learn.sum()) / (1 + (x[learn] > 0).sum(0))) + 1, 4)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    z = np.hstack([unit(x[:, : Q.STYLE] * idf[: Q.STYLE]), Q.WORD_SHARE * unit(x[:, Q.STYLE :] * idf[Q.STYLE :])])
    axes = np.linalg.svd(z[learn], full_matrices=False)[2][: Q.RANK]
    s = unit(z @ axes.T) @ unit(z[learn] @ axes.T).T
    out = []
    for row in s:
        near = np.argsort(-row)[: Q.NEIGHBOURS]
        w = np.maximum(row[near], 1e-6) ** Q.POWER
        out.append((w * y[learn][near]).sum() / w.sum())
    return np.array(out)


def test_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    want = plain_scores(docs, labels)
    got = op3_quality_classifier(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id].score.to_numpy()
    assert np.abs(got - want).max() < 0.05 and np.median(np.abs(got - want)) < 1e-3


def test_ties_at_the_last_place_all_vote():
    known = np.eye(4)[[0, 1, 1, 1, 2]]
    z = Q._unit(np.array([[2.0, 1.0, 0.0, 0.0]]))
    a, b = Q.vote(z, known, np.array([0.0, 1, 1, 0, 1]), 2, 1), Q.vote(z, known[::-1], np.array([0.0, 1, 1, 0, 1])[::-1], 2, 1)
    w = z[0] @ known[[0, 1, 1, 1]].T
    assert np.allclose(a, b) and np.isclose(a[0], (w * [0, 1, 1, 0]).sum() / w.sum())
