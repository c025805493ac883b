import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `print` string, chunk int"


@pytest.fixture
def make_docs(spark):
    """Documents with columns whose names the operators use for their own."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make
