import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, schema="doc_id long, text string, source string"):
        width = len(schema.split(", "))
        return spark.createDataFrame([tuple(r) + ("s",) * (width - len(r)) for r in rows], schema)
    return make
