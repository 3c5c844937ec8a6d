"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from waymark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if isinstance(x, str) or x is None:
            return x
        if isinstance(x, pd.Timestamp):
            return str(x)
        if pd.isna(x):
            return None
        return x if isinstance(x, bool) else round(float(x), 6) + 0.0

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).schema == QUERIES["strict_bins"](spark, SF).schema


def test_core_queries_remain_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import then fails, as it does without its libraries
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
