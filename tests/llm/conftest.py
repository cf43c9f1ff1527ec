import pytest

from veilmark.llm.common import stored

LONG = "word " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with names the operators use."""
    text = "One two three four five six seven eight nine ten eleven twelve, call +1 415 555 0100 or mail a.b@c.example.org."
    rows = [(1, text, "en", "s", 7), (1, text, "en", "s", 7), (2, text, "en", None, 7), (3, None, None, None, None), (4, "", "en", "s", 0),
            (5, LONG, "de", "t", 0), (None, "a null id", None, "s", 1), (6, " \t\n ", "fr", "", 2), (7, "x" * 5000, "fr", "t", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "k", "size", "src", "shard", "kept", "length", "_key", "_base", "node", "rank", "_kept"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return stored(frame)
