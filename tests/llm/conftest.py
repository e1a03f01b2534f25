import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near an old stone bridge and count every passing cloud before night falls on their quiet village"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty texts, a very long text, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, PROSE, "en", "a", 1), (5, PROSE.replace(" ", "\n"), "en", "b", 1), (5, PROSE.replace(" ", "\n"), "en", "b", 1),
        (6, PROSE.upper(), "de", "a", 2), (None, PROSE, "en", "a", 1), (None, None, None, None, None), (7, "one two", "en", "a", 3), (8, ("é漢😀 word\x00 x1 " * 40_000), "en", "a", 4), (9, PROSE + " extra", "en", "a", 5), (4, "same id another text", "en", "a", 5),
    ]
    extra = [(*r, "x", 1.0, 7, "y", "z", 2, True) for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", key string, score double, component_id int, row string, digest string, n int, kept boolean")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, None, 1), (None, 1, 1), (4, 1, 0), (9, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, "Fox jumps"), (3, None), (4, " .. "), (1, PROSE), (10, "no such words here")], "item_id bigint, text string")
