import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use themselves."""

    def make(rows, extra=True):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("part", "key", "fp", "size", "doc_text", "first", "line", "score", "target"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated and very long texts."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "long " * 60_000), (6, "same words here"), (7, "same words here"), (7, "same words here"), (8, "ünï çødé – “x” 漢字   z")]
