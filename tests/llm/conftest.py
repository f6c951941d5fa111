import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ranges string, k0 int, node string, spans int, row int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, copies, and columns with likely clashes."""
    long_ = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(120))
    near = base.replace("tok60 ", "other ")
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, 1), (3, near, "en", None, 1), (4, "", "en", "a", 0), (5, None, None, None, None), (None, base, "en", "a", 1), (None, None, None, None, None),
        (6, "   \n\t ", "de", "a", 1), (7, long_, "en", "a", 1), (8, "und der die das ist nicht", "de", "a", 1), (9, "the and of it was not", "en", "a", 1), (9, "the other text of this id", "en", "a", 1), (10, "12345 %% 99", "en", "a", 1),
        (11, "one two", "en", "a", 1), (12, "one two", "en", "a", 1), (13, "▁ a b  c ", "fr", "a", 1), (14, "x" * 200_000, "fr", "a", 1),
    ]
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
