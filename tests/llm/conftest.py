import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from texts, or from (doc_id, text, source)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS)

    return make
