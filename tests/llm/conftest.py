import pytest

MESSY = "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_topic string, component bigint, findings string"


@pytest.fixture(scope="session")
def messy(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, words, "en", "a", 1, "x", 7, "f"), (1, words, "en", "a", 1, "x", 7, "f"),
        (2, words.upper(), "en", "a", 1, None, None, None), (None, words, "en", None, None, None, None, None),
        (3, None, "en", "b", 0, None, None, None), (4, "", None, None, 0, None, None, None),
        (5, " \t\n ", "fr", "b", 3, None, None, None), (6, "12345 !!! ???", "fr", "b", 9, None, None, None),
        (7, "one two", "fr", "b", 7, None, None, None), (7, "other text with the same id", None, "b", 7, None, None, None),
        (8, "long " * 60_000 + "tail", "fr", "a", 1, None, None, None),
        (9, 'token = "abcdef123456" and mail a.b12@mail.example.com é', "fr", "a", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, MESSY).coalesce(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], MESSY)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30, 60))), (2, "one two"), (3, None), (None, "x y"), (4, "")],
                                 "item_id bigint, text string")
