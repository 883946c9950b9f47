import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, s string, _hit string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [
        (None, "some text without an id that goes on for a while", "en", None, None),
        (1, None, None, "a", 3),
        (2, "", "en", "a", 0),
        (3, "  \n\t ", "en", "a", 5),
        (4, long, "de", "b", len(long)),
        (5, long, "de", "b", len(long)),
        (6, "one two three four five six seven eight nine ten.\nReleased under the MIT License.", "en", "c", 80),
        (6, "one two three four five six seven eight nine ten.\nReleased under the MIT License.", "en", "c", 80),
        (7, "word", "xx", "c", 4),
    ]
    return spark.createDataFrame([(*r, 9, "k", "x", "h") for r in rows], DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
