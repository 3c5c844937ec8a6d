import numpy as np

from waymark.llm import embedding_dedup as E


def brute(rows):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    ok = [lab is not None and usable(v) for _, lab, v in rows]
    root, deg = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = (np.array(rows[k][2], np.float64) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    deg[i] += 1
                    deg[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], deg[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def vectors(seed=1, crowd=300):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.standard_normal((30, 16))
    for c in range(30):
        for _ in range(r.integers(1, 8)):
            rows.append((c % 3, centres[c] + r.standard_normal(16) * r.choice([0.02, 0.15, 0.3])))
    rows += [(0, centres[0] * k) for k in (1, 1, 2, 0.5)]
    rows += [(1, centres[5] + r.standard_normal(16) * 0.1) for _ in range(crowd)]
    return [(i, int(lab), [float(np.float32(x)) for x in v]) for i, (lab, v) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, n_links int")


def test_equals_brute_force_also_where_a_crowd_is_wider_than_a_block(spark):
    rows = vectors()
    got = sorted(tuple(r) for r in E.near_duplicates(frame(spark, rows), window=32, block=64, miss=0.0005, task_rows=300).collect())
    assert got == brute(rows)


def paired(n, dim, common, seed):
    """n unit vectors of one label with a mean cosine of `common`, and a partner at cosine 0.931 for each of the first tenth."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    x = unit(np.sqrt(common) * unit(r.standard_normal(dim)) + np.sqrt(1 - common) * unit(r.standard_normal((n, dim))))
    side = r.standard_normal((n // 10, dim))
    own = x[: n // 10]
    side = unit(side - (side * own).sum(1, keepdims=True) * own)
    return np.vstack([x, 0.931 * own + np.sqrt(1 - 0.931**2) * side]), n


def test_recall_at_the_threshold_also_where_all_vectors_share_a_direction(spark):
    for common in (0.0, 0.5, 0.8):
        x, n = paired(6000, 64, common, 3)
        df = frame(spark, [(i, 1, v) for i, v in enumerate(x.tolist())])
        got = {r.vec_id: r.n_links for r in E.near_duplicates(df, window=32).collect()}
        want = (x @ x.T >= 0.93).sum(1) - 1
        assert all(got[i] <= want[i] for i in got)
        assert sum(got.values()) >= 0.97 * want.sum() and want[:600].sum() >= 600, common


def test_passes_grow_with_the_table_and_have_no_cap():
    few, many, most = (E.passes_for(n, 0.93) for n in (10**4, 10**8, 10**10))
    assert few < many < most and most > 100
    for n in (10**4, 10**8, 10**10):
        hit = E.agreement(1.0, 0.93) ** max(1.0, np.log2(n / E.WINDOW) + 1)
        assert (1 - hit) ** E.passes_for(n, 0.93) <= E.MISS


def test_rows_that_share_an_id_have_the_links_of_their_own_label(spark):
    v = [1.0, 2.0, 0.0]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(frame(spark, [(5, 1, v), (5, 2, v), (6, 2, v), (7, 1, v)])).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    other = [0.0, 0.0, 1.0]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(frame(spark, [(5, 1, v), (5, 1, other), (6, 1, other), (4, 1, v)])).collect())
    assert got == [(4, 1, 4), (5, 1, 4), (5, 1, 5), (6, 1, 5)]


def test_unusable_vectors_and_empty_tables(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, 1, v), (2, 1, v), (3, None, v), (4, 1, None), (5, 1, [0.0, 0.0, 0.0]), (6, 1, [1.0, None, 0.0]), (7, 1, [float("nan"), 1.0, 0.0]), (8, 1, [float("inf"), 1.0, 0.0]), (9, 1, [1.0, 2.0]), (10, 2, v), (11, 1, [])]
    got = sorted(tuple(r) for r in E.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)] + [(i, 0, i, True) for i in range(3, 12)]
    again = E.near_duplicates(frame(spark, [(None, 1, v), (2, 1, v), (2, 1, v)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in again) == [(0, 2, 2), (2, 2, 2), (2, 2, 2)]
    assert E.near_duplicates(frame(spark, [])).count() == 0
