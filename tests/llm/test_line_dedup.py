import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import line_dedup as L
from waymark.llm.queries import op8_line_dedup


def brute(rows):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def rows():
    shared = ["A line that many documents share É", "\ta LINE that many documents share É ", "x" * 19, "y" * 20, " not ascii space at its ends "]
    out = [(i, "\n".join([f"own line of document number {i}", shared[i % 5], "", shared[(i + 1) % 5], shared[i % 5]])) for i in range(40)]
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "z" * 100_000 + "\n" + shared[0])]


def test_query_equals_brute_force(spark, folder):
    got = sorted(tuple(r) for r in op8_line_dedup(spark, folder(rows())).collect())
    assert got == brute(rows())


def test_shards_and_tasks_change_nothing(docs_of):
    a, b, c = (sorted((r.doc_id, r.text) for r in L.dedup_lines(docs_of(rows()[:40]), shard_keys=k, task_rows=n).collect()) for k, n in ((1 << 20, 1 << 20), (1, 7), (2, 1)))
    assert a == b == c


def test_null_ids_repeats_and_empty_tables(docs_of):
    line = "a line of more than twenty characters"
    of = lambda *given: sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(docs_of(given)).collect())
    assert of((None, line), (1, line), (1, line), (7, line)) == [(0, ""), (1, ""), (1, ""), (7, line)]
    assert of((None, line), (None, line), (None, line)) == [(0, line)] * 3  # one document
    assert of((7, line), (7, line), (7, line + "\nx")) == [(7, line), (7, line), (7, line + "\nx")]
    assert of((7, line), (7, line), (1, line)) == [(1, line), (7, line), (7, line)]
    assert L.dedup_lines(docs_of([])).count() == 0
    assert "score" in L.dedup_lines(docs_of([(1, "a")])).columns


def test_columns_of_clashing_names_pass_through(docs_of):
    names = ("n_lines", "n_dropped", "kept_sha256", "rid", "h1", "h2", "n", "shard", "salt", "kind", "last_doc")
    line = "a line of more than twenty characters"
    d = docs_of([(i, line) for i in range(4)])
    for i, c in enumerate(names):
        d = d.withColumn(c, F.lit(i))
    got = L.dedup_lines(d).collect()
    assert sorted((r.doc_id, r.text, r["__n_dropped"]) for r in got) == [(0, "", 1), (1, "", 1), (2, "", 1), (3, line, 0)]
    assert all(r[c] == i for r in got for i, c in enumerate(names))


def test_insertions_and_deletions_are_reversible(spark, docs_of):
    old, new = docs_of(rows()[:20]), docs_of(rows()[20:40])
    before = L.line_references(old)
    after = L.delete(L.insert(before, new), new)
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    counts = L.reference_counts(before).where("n_docs >= 3")
    filters = L.build_filters(counts, 2)
    assert L.delete(L.insert(before, docs_of([(None, "the line of a document without an id")])), docs_of([(None, "")])).count() == before.count()
    more = spark.createDataFrame([(11, 12), (-5, 1 << 40)], "h1 long, h2 long")
    grown = L.update_filters(filters, more, more.limit(0), 2)
    back = L.update_filters(grown, more.limit(0), more, 2)
    fill = lambda f: sum(int((np.frombuffer(r["slots"], np.uint16) > 0).sum()) for r in f.collect())
    assert fill(grown) == fill(filters) + 2 and fill(back) == fill(filters)


def test_cuckoo_filter_has_no_false_negatives_and_few_false_positives():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    c = L._filter_of(*h)
    assert c.contains(*h).all()
    other = r.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    assert c.contains(*other).mean() < 0.001
    c.delete(h[0][:10_000], h[1][:10_000])
    assert c.contains(h[0][10_000:], h[1][10_000:]).all() and c.contains(h[0][:10_000], h[1][:10_000]).mean() < 0.01
