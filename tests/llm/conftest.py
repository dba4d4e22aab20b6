import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, " \
       "shard int, row_number long, mix string"

# nulls in every column, empty and very long texts, copies, repeated rows
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and the cat", "en", "b", 55, 1, 1, 1, 1, "m"),
    (2, "the quick brown fox jumps over the lazy dog and the cat", "en", "a", 55, 1, 1, 1, 1, "m"),
    (3, "", "en", "a", 0, None, None, None, None, None),
    (4, None, "en", "a", None, None, None, None, None, None),
    (5, "   \n\t ", None, None, None, None, None, None, None, None),
    (None, "null id here, write to a.b@c.example now", "de", "c", None, None, None, None, None, None),
    (7, LONG, "en", "b", None, None, None, None, None, None),
    (8, "one", None, None, None, None, None, None, None, None),
    (9, "12345 67890 !!!", "fr", "c", None, None, None, None, None, None),
    (9, "12345 67890 !!!", "fr", "c", None, None, None, None, None, None),
    (10, "der schnelle braune Fuchs springt über den faulen Hund ß", "de", "c", None, None, None,
     None, None, None),
    (10, "another text under the same id", "en", "c", None, None, None, None, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
