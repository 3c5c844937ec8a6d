import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with an extra column of a clashing name."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score string")

    return build


@pytest.fixture
def folder(docs_of, tmp_path):
    """Writes such rows as documents.parquet and gives the folder."""

    def write(rows):
        docs_of(rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write
