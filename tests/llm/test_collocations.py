"""Phrases against DuckDB and a plain count, with groups and prefixes of every size."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import collocations as C
from waymark.llm.oracles import ORACLES
from waymark.llm.queries import QUERIES


def plain(rows, least, top):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, n in f.items():
        held, found = {p: a for p, a in n.items() if len(p) > 1 and a >= least}, []
        for p, a in held.items():
            score, _, left, right = min((2000000 * a // (n[p[:k]] + n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed=3, n=120):
    r = random.Random(seed)
    words = ["a", "b", "c", "dd", "É", "漢字", "x\x00y", " ", "Q" * 40]
    line = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", ";x!"]) for _ in range(r.randint(0, 60)))
    rows = [(line(), r.choice(["en", "fr", None, "und"])) for _ in range(n)]
    hot = [("of the Of the of", "en")] * 60
    return [*rows, *hot, (None, "en"), ("", "fr"), (" \t\n.", "de"), ("one", None), ("z " * 30_000, "long"), ("y" * 3_000_000 + " y", "long")]


@pytest.mark.parametrize("budget", [C.BUDGET, 300, 40])
def test_phrases_equal_a_plain_count(spark, budget):
    rows = texts()
    df = spark.createDataFrame([(i, t, lang, 1, b"x") for i, (t, lang) in enumerate(rows)], "n long, text string, lang string, score int, key binary")
    got = C.collocations(df, 10, 25, budget).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10, 25)
    assert C.collocations(df.limit(0)).count() == 0


def test_words_across_chunks_and_long_words(monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 64)
    r = random.Random(1)
    docs = ["".join(r.choice("ab .\n\té") for _ in range(r.randint(0, 200))) + "w" * 100 for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 30, "text": docs}).slice(3)
    got = []
    for low, first, row, w in C._read(C.Reader(1), batch):
        data = low.tobytes()
        got += [(int(row[d]), data[s + first : e + first], int(c), bool(g)) for d, s, e, c, g in zip(w.doc, w.start, w.end, w.code, w.goes_on, strict=True)]
    want = []
    for i, d in enumerate(docs[3:]):
        for piece in re.split("[.\n]", d):
            ws = [x for x in re.split("[ \t]", piece) if x]
            want += [(i, x.encode(), j < len(ws) - 1) for j, x in enumerate(ws)]
    assert [(a, b, d) for a, b, _, d in got] == want
    code = {}
    assert all(code.setdefault(b, c) == c for _, b, c, _ in got) and len(set(code.values())) == len(code)


def test_bits_hold_all_codes_and_few_others(spark):
    codes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    bits = C.bits_of(spark.createDataFrame([(int(c),) for c in codes], "code long"), codes.size)
    assert C.has(bits, codes.view(np.uint64)).all()
    assert C.has(bits, np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.02


def test_query_equals_sql(spark, docs_of, tmp_path):
    docs_of([(i, t, lang) for i, (t, lang) in enumerate(texts(9, 300)[:-2])]).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    q = QUERIES["op13_collocations"](spark, str(tmp_path))
    rows = sorted(map(tuple, q.collect()))
    assert rows and rows == sorted(c.sql(f"SELECT {', '.join(q.columns)} FROM ({ORACLES['op13_collocations']})").fetchall())


def test_what_leaves_a_task_at_once_is_bounded():
    """200,000 distinct words in one batch leave in parts, and their counts are whole."""

    class Docs:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 20), pa.array([" ".join(f"w{d}x{i} same" for i in range(5000)) for d in range(40)])], names=["lang", "text"])
            self.out = [*run(iter([batch]))]
            return self

        def groupBy(self, *_):
            return self

        agg = groupBy

    every = np.full(1 << 10, 255, np.uint8)
    counted, found, cut = Docs(), Docs(), Docs()
    C._scan(counted, 1, C._count_words, "")
    C.prefixes(found, 1, 2, every, None, {})
    C.suffixes(cut, 1, every, every, {}, 7)
    for d in (counted, found, cut):
        assert len(d.out) > 1 and max(b.num_rows for b in d.out) <= 1 << 16
    words = Counter()
    for b in counted.out:
        for lang, word, n in zip(*(b[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
            words[lang, word] += n
    assert words["en", None] == words["de", None] == 200_000 and words["de", "same"] == 100_000 and words["de", "w39x4999"] == 1 and len(words) == 200_004
    assert sum(sum(b["n"].to_pylist()) for b in found.out) == sum(sum(b["n"].to_pylist()) for b in cut.out) == 40 * 9999
