import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, and columns that operators use as names of their own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog by the river.", "en", "a", 57),
        (1, "The quick brown fox jumps over the lazy dog by the river.", "en", "a", 57),
        (2, None, "de", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "b", 4),
        (None, "A text without an id, and its words.", "en", "b", 36),
        (5, LONG, "en", "a", len(LONG)),
        (6, "ß é 日本 \U0001f600 \x00 \x1c end", None, "c", 20),
        (7, "...!!!,,,", "es", "c", 9),
    ]
    out = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "spans", "base", "fp", "digest", "place", "n", "row", "print", "id"):
        out = out.selectExpr("*", f"'clash' AS `{name}`")
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
