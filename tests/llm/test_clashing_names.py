"""Extra columns named like an operator's results, or like what it uses inside, change nothing."""

import random

import public_tokenizers

from waymark.llm import bpe, mixing, near_copies, quality_rules


def test_extra_columns_change_no_result(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta.", "Eps\n"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 120)), r.choice(["en", None]), r.choice("ab")) for i in range(90)]
    rows += [(200, rows[3][1], "en", "a"), (201, None, None, None), (202, text(200_000), "en", "b")]
    extra = "size long, target double, taken long, n_words int, kept boolean, level string, distance double, n_tokens long, ids_sha256 string, code long, root string, n int, bands int, rid string, g string, h int, i int, v int, a int, b int"
    full = spark.createDataFrame([(*x, 7, 0.5, 7, 7, False, "x", 1.5, 7, "x", 7, "x", 7, 7, "x", "x", 7, 7, 7, 7, 7) for x in rows], "doc_id long, text string, lang string, source string, " + extra)
    plain = full.select("doc_id", "text", "lang", "source")
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for run in (lambda d: mixing.mix(d).select("doc_id", "__size", "__target", "__taken"), lambda d: quality_rules.judge(d).select("doc_id", "n_words", "base_failed", "kept"), lambda d: bpe.digest(d, path)):
        assert rows_of(run(full)) == rows_of(run(plain))
    kept = near_copies.keep_one(full)
    assert kept.columns == full.columns and rows_of(kept.select("doc_id")) == rows_of(near_copies.keep_one(plain).select("doc_id"))
    assert 200 not in {x.doc_id for x in kept.collect()} and 202 in {x.doc_id for x in kept.collect()}
