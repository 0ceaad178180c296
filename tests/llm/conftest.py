import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, verdict string"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text, lang) rows; ``verdict`` is a column of another operator's result."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), "x") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make
