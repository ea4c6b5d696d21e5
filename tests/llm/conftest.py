import pytest


@pytest.fixture
def docs(spark):
    def make(texts, **more):
        rows = [(i, t) for i, t in enumerate(texts)] if not isinstance(texts, dict) else list(texts.items())
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
