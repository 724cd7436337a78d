import pytest

LONG = "lorem ipsum dolor sit amet " * 3000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "a text without an id that has a few more words than ten in all", "en", None, 3),
    (None, None, None, None, None),
    (4, " \n\t ", "de", "s", 3),
    (5, LONG, "en", "t", len(LONG)),
    (5, "the id five again but with another text which is long enough to stay", "fr", "t", 9),
    (6, "schöne Grüße 🙂 naïve Wörter aus mehreren Sprachen mit vielen anderen Zeichen", "de", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names an operator may use."""
    names = ["key", "path", "component", "host", "Drop", "own_key", "other_id", "other_key", "text_hash", "own_hash", "other_hash", "words", "n", "x", "row", "rid"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], SCHEMA + "".join(f", `{n}` int" for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
