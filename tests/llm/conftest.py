import pytest

EXTRA = "doc_id long, text string, lang string, source string, h1 string, id int, version int, copies string, n int"


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes documents, with extra columns whose names the operators use inside; texts or (id, text, lang, source) rows."""
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", "a")
            full.append((doc_id, text, lang, source, "x", 1, 2, "y", 3))
        return spark.createDataFrame(full, EXTRA)
    return make
