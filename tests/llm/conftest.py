import pytest


@pytest.fixture(autouse=True)
def _clean(spark):
    yield
    from graphloom.llm.common import release

    release(spark)


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names might clash."""

    def make(rows):
        full = [(i, t, "x", None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, keep_id string, __row string")

    return make
