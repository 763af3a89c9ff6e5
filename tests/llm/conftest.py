import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, numbered from 0, or from (doc_id, text) pairs."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    return build
