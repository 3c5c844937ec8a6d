import hashlib
import itertools
import random
from collections import Counter

from waymark.llm import substring_dedup as S
from waymark.llm.queries import op1_substring_dedup


def brute(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "a\x00b", " "]
    fresh = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [fresh(k) for k in (34, 35, 36, 50, 80, 200)]
    rows = []
    for i in range(n):
        w = fresh(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w = w[:at] + r.choice(passages) + w[at:]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    long = fresh(3000)
    rows += [(1000, None), (1001, ""), (1002, "short text"), (1003, " ".join(["same"] * 400)), (1004, " ".join(["a", "b"] * 100))]
    rows += [(1005, " ".join(long)), (1006, " ".join(long[100:900] + ["x"] + long[901:])), (1007, " ".join(long[:35])), (1008, " ".join(long[50:84]))]
    return rows + [(2000 + i, " ".join(passages[4] + passages[5])) for i in range(30)]


def local(rows, group):
    """The operator's steps without Spark, over frames in two batches each."""
    import pandas as pd

    docs = pd.DataFrame({"__rid": [d for d, _ in rows], "text": [t for _, t in rows]})
    batches = lambda f, k=37: (f.iloc[i : i + k] for i in range(0, len(f), k))
    a = pd.concat(S._emit_anchors(35, 12)(batches(docs)), ignore_index=True)
    n = a.groupby("h")["h"].transform("size")
    hits = a[n > 1].assign(hot=(n > group).astype(int))
    hits["x"] = hits["place"] * 2 + hits["hot"]
    docs = docs.merge(hits.groupby("rid")["x"].agg(lambda s: sorted(set(s))).rename("__hits"), left_on="__rid", right_index=True)
    s = pd.concat(S._emit_stretches(35, 12)(batches(docs))).sort_values(["h", "kind", "data"])
    return pd.concat(S._find_repeats(35, 12)(batches(s, 53)))


def test_steps_equal_brute_force_with_and_without_lengthened_prefixes():
    for seed in range(4):
        rows = corpus(seed)
        want = {d: n for d, _, n, _ in brute(rows)}
        for group in (2000, 3, 0):
            got = {d: set() for d in want}
            for x in local(rows, group).itertuples():
                got[x.rid] |= set(range(x.start, x.stop))
            assert {d: len(x) for d, x in got.items()} == want, (seed, group)


def test_parent_depths_equal_brute_force():
    r = random.Random(2)
    for deep in (1, 3, 5):
        paths = list({bytes(8 * r.randint(deep, 12)) for _ in range(3)} | {b"".join(r.randrange(3).to_bytes(8, "little") for _ in range(r.randint(deep, 14))) for _ in range(12)})
        words = [[p[i : i + 8] for i in range(0, len(p), 8)] for p in paths]
        own = [(i, j) for i, w in enumerate(words) for j in range(len(w) - deep + 1)]
        for i, j, depth in zip(*S.parent_depths(paths, deep), strict=True):
            a = words[i][j:]
            shared = max((sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(a, words[x][y:], strict=False))) for x, y in own if (x, y) != (i, j)), default=0)
            assert depth == (shared if shared >= deep else 0)


def test_columns_of_clashing_names_and_long_texts(docs_of):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(40))
    d = docs_of([(1, text), (2, text + " x"), (3, "own words"), (4, " ".join(f"v{i}" for i in range(300_000)))])
    for c in ("rid", "h", "hot", "n", "place", "first", "kind", "data", "start", "stop", "n_words", "kept_sha256"):
        d = d.withColumn(c, F.col("doc_id"))
    got = {x["doc_id"]: x for x in S.remove_repeats(d).collect()}
    assert [got[i]["__n_removed"] for i in (1, 2, 3, 4)] == [40, 40, 0, 0] and got[2]["__kept"] == "x" and got[4]["__n_words"] == 300_000
    assert all(x["hot"] == i and x["kept_sha256"] == i for i, x in got.items())


def test_query_equals_brute_force(spark, folder):
    rows = corpus(7) + [(None, "n " * 40), (5000, "r s " * 30), (5000, "r s " * 30)]
    got = sorted((tuple(r) for r in op1_substring_dedup(spark, folder(rows)).collect()), key=str)
    assert got == brute(rows)


def test_lengthened_prefixes_and_empty_tables(docs_of):
    rows = corpus(9)
    got = S.remove_repeats(docs_of(rows).select("doc_id", "text"), group=3).collect()
    assert sorted((r["doc_id"], r["__n_removed"]) for r in got) == sorted((d, n) for d, _, n, _ in brute(rows))
    assert S.remove_repeats(docs_of([]).select("doc_id", "text")).count() == 0
