import pytest

from llm_texts import prose


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator must take: null and empty texts, ties, repeated rows, null ids, and a very long text."""
    long = prose(1, 60_000)
    return [(1, None), (2, ""), (3, "  \n\t"), (4, prose(2, 50)), (4, prose(2, 50)), (5, prose(2, 50)), (None, prose(2, 50)), (6, long), (7, "one"), (8, "ünïcode  text \U0001f600"), (None, None)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table whose other columns clash with the operators' own."""

    def build(rows):
        columns = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, digest string, key long, size long, doc long, mark string, id string, node long, spans string, `a.b` int"
        full = [(i, t, "en", "s", len(t or ""), True, 0.5, "x", 1, 2, 3, "m", "i", 4, "sp", 5) for i, t in rows]
        return spark.createDataFrame(full, columns)

    return build
