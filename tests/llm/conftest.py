import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, taken int, _id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, copies, and columns with clashing names."""
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 1, "i"),
        (2, "the  quick brown\tfox jumps over the lazy dog", "en", "b", 44, None, None, None),
        (2, "the  quick brown\tfox jumps over the lazy dog", "en", "b", 44, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", 1, "i"),
        (5, " \n\t ", "en", "a", 4, "x", 1, "i"),
        (6, long, "en", "a", len(long), "x", 1, "i"),
        (7, long + " tail", "en", None, len(long) + 5, "x", 1, "i"),
        (8, "one two", "en", "c", 7, "x", 1, "i"),
        (9, "ünï çode <|endoftext|> d'été\x0b\x85 \r\n x  ", "fr", "c", 10, "x", 1, "i"),
        (None, "null id text with some words in it", "en", "c", 10, "x", 1, "i"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
