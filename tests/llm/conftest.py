import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra and clashing columns."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, " \n\t ", "en", "s", 4, 1), (4, long, "en", "s", len(long), 1), (5, long, "en", "t", len(long), 2),
        (6, "short text", "en", "t", 10, 1), (6, "short text", "en", "t", 10, 1), (7, "Ünïcode ☃ 😀 " * 60, "de", None, 5, 1), (8, "a" * 5000, "en", "u", 5000, 1), (None, "no id here at all", "en", "s", 3, 1), (9, "x\u0000y�", "en", "s", 3, 1),
    ]
    return spark.createDataFrame(rows, DOCS + ", score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
