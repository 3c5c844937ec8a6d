from pyspark.sql import functions as F

from waymark.llm import mixing
from waymark.llm.queries import op2_mixing


def test_targets_are_met_and_no_source_is_above_its_cap(spark, folder):
    rows = [(i, "w " * (i % 37), "en", f"s{i % 5}" if i % 11 else None) for i in range(600)]
    rows += [(1000 + i, "hot words here", "en", "s1") for i in range(900)]
    out = op2_mixing(spark, folder(rows)).toPandas()
    assert len(out) == len(rows)
    assert (out.taken <= 2 * out["size"]).all()
    full = out.merge(__import__("pandas").DataFrame([(r[0], r[3] or "~") for r in rows], columns=["doc_id", "source"]))
    per = full.groupby("source").agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.stated).all() and ((per.taken - per.target).abs() < 1).all()
    assert (per.target <= 2 * per["size"] + 1e-9).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    free = per[per.target < 2 * per["size"] - 1e-9]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(["s0", "s1", "s2", "s3", "s4", "~"])}
    levels = {round(t / weights[s], 6) for s, t in free.target.items()}
    assert len(levels) == 1


def test_reruns_agree_and_positions_follow_the_schedule(docs_of):
    docs = docs_of([(i, "w " * (1 + i % 9), "en", f"s{i % 3}") for i in range(3000)])
    a, b = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a["__taken"].equals(b["__taken"])
    e = mixing.mix(docs).select("source", F.explode("__passes").alias("p")).select("source", "p.*").toPandas()
    assert e.position.between(0, 1).all()
    halves = {s: g[g.position < 0.5].words.sum() / g.words.sum() for s, g in e.groupby("source")}
    assert abs(halves["s0"] - 0.625) < 0.01 and abs(halves["s1"] - 0.5) < 0.01 and abs(halves["s2"] - 0.375) < 0.01


def test_nulls_repeats_and_empty_tables(spark, folder, docs_of):
    out = op2_mixing(spark, folder([(None, "a b", "en", None), (1, None, "en", "x"), (1, None, "en", "x"), (2, "", "en", "x"), (3, "a b c", "en", "x"), (3, "a b c", "en", "x")])).toPandas()
    assert len(out) == 6 and (out.taken <= 2 * out["size"]).all()
    assert op2_mixing(spark, folder([])).count() == 0
    assert mixing.in_order(mixing.mix(docs_of([(1, None)]))).first()["__taken"] == 0
