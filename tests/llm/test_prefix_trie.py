"""The trie against a plain one in dictionaries and against DuckDB, over shards and blocks of every size."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from waymark.llm import prefix_trie as P
from waymark.llm.oracles import ORACLES
from waymark.llm.queries import QUERIES


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    new = {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in own.items()}
    nodes = {}
    for c, t in new.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, held in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        ends = ",".join(str(c) for c in sorted(held) if len(new[c]) == len(path))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((min(held), len(path), min(nodes[path[:-1]]) if path else None, len(held), sum(len(q) == len(path) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=90):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-60, 400), n):
        for i in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([i, i, None, 2]), r.choice(["user", "assistant", None]), r.choice(["", "a b", "a", "one\ttwo three\n", None, "é 漢"])))
    first = [(c, i, "user", f"same {i}") for c in range(1000, 1200) for i in range(4)]
    long = [(7, 100 + i // 3, "user", f"turn {i % 50}") for i in range(300)]
    again = [(1000 + c % 3, 9, "x", "again") for c in range(40)]
    return [*rows, *first, *long, *again, (None, 1, "user", "nobody"), (2001, 0, "a", "x"), (2001, 0, "a", "x"), (9, 0, "u", "w " * 50_000)]


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


@pytest.mark.parametrize(("shard", "depth"), [(P.SHARD, P.DEPTH), (3, 2)])
def test_the_trie_equals_a_plain_one(spark, monkeypatch, shard, depth):
    monkeypatch.setattr(P, "SHARD", shard)
    monkeypatch.setattr(P, "DEPTH", depth)
    rows = made(4)
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    got = P.trie(*P.rebuilt(df)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.trie(*P.rebuilt(df)).count() == 0
    turnless = [(c, 0, "u", "t") for c in (21, 22, 41, 61, 81, 101) if zlib.crc32(str(c).encode()) % 4]
    got = P.trie(*P.rebuilt(spark.createDataFrame(turnless, df.schema))).select(*COLUMNS).collect()
    assert turnless and sorted(map(tuple, got), key=str) == plain(turnless) and got[0]["n_leaves"] == 1


def test_query_equals_sql(spark, tmp_path):
    rows = made(8)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()
    want = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_prefix_trie']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) == plain(rows)
