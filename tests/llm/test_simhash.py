import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from waymark.llm import simhash as S
from waymark.llm.queries import op6_simhash


def own_print(text):
    w = [x.lower() for x in (text or "").encode().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def own_components(rows):
    prints = [own_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min([x for x in (low.get(find(i)), d) if x is not None], default=None)
    return sorted(((d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def corpus():
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(400)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(150):
        w = r.choice(base[:8]).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "One"), (905, "two words"), (906, "É é"), (None, "one"), (907, "one"), (907, "one"), (None, "alone here now")]


def test_query_equals_brute_force(spark, folder):
    got = sorted((tuple(r) for r in op6_simhash(spark, folder(corpus())).collect()), key=str)
    assert got == own_components(corpus())


def test_any_limit_gives_the_same_components(docs_of):
    a, b = (sorted(((r.doc_id, r.component) for r in S.near_duplicates(docs_of(corpus()), limit=n).collect()), key=str) for n in (1, 1000))
    assert a == b


def test_links_for_any_number_of_bits(spark):
    r = random.Random(4)
    codes = {r.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:30]:
        for _ in range(6):
            x = c
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            codes.add(x)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    from waymark.llm._components import components

    for bits in (1, 2, 3):
        for limit in (1, 100):
            got = {x["node"]: x["root"] for x in components(S.links(df, bits, limit)).collect()}
            root = {c: c for c in signed}
            changed = True
            while changed:
                changed = False
                for a in signed:
                    for b in signed:
                        if (a ^ b).bit_count() <= bits or ((a ^ b) % (1 << 64)).bit_count() <= bits:
                            if root[b] < root[a]:
                                root[a], changed = root[b], True
            assert {c: got.get(c, c) for c in signed} == root, (bits, limit)


def test_partitions_and_thresholds():
    assert S.allocate([[0, 5, 9], [0, 1, 2], [0, 1, 9]], 2) == (3.0, [-1, 1, 0])
    both = np.full((64, 64), 25.0) + np.eye(64) * 25
    both[3, 60] = both[60, 3] = 50
    parts = S.partitions(100, both, [21, 21, 22])
    assert sorted(b for p in parts for b in p) == list(range(64)) and any({3, 60} <= set(p) for p in parts)


def test_keep_one(docs_of):
    out = S.keep_one(docs_of([(3, "a b c d"), (1, "A b c d"), (2, "other words are here"), (None, "q r s"), (None, None), (2, "other words are here")]))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, "q r s"), (1, "A b c d"), (2, "other words are here")]
    assert S.near_duplicates(docs_of([])).count() == 0 and S.keep_one(docs_of([])).count() == 0
    assert S.fingerprints(docs_of([(1, "x " * 100_000)])).agg(F.count("code")).first()[0] == 1


def test_crowded_partitions_give_way_to_wider_ones(spark):
    """Where narrow partitions are crowded, the plan takes wider ones with larger thresholds, not the flips."""
    r = np.random.default_rng(1)
    few = [int(x) for x in r.integers(0, 1 << 62, 3)]
    low = (1 << 43) - 1  # 43 bits take three values, 21 are free
    codes = {(f & low) | int(x) << 43 for f in few for x in r.integers(0, 1 << 20, 1500)}
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    chosen = S.plan(df, 2)
    sizes = [Counter(c & sum(1 << b for b in part) for c in codes).most_common(1)[0][1] for part, _ in chosen]
    assert max(sizes) <= S.LIMIT and any(t > 0 for _, t in chosen)


def test_clashing_names(docs_of):
    d = docs_of([(i, "a b c d e f" if i % 2 else f"own words of {i} are here") for i in range(6)])
    for c in ("rid", "code", "root", "component", "low", "n", "component_id", "fingerprint"):
        d = d.withColumn(c, F.col("doc_id"))
    assert sorted((r.doc_id, r.root, r.fingerprint) for r in S.keep_one(d).collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (4, 4, 4)]
