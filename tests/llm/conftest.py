import pytest


@pytest.fixture
def docs(spark):
    def make(rows):
        """Documents from (doc_id, text, source), with a column that clashes with operators' own names."""
        return spark.createDataFrame([(i, t, "en", s, None, "x", 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, size int")

    return make
