import pytest

#: Column names that operators might use inside; a table may have them too.
CLASHES = ("row", "gone", "line", "pos", "key", "node", "id", "score", "label", "block", "hub", "at", "u", "v", "first")


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text) rows, with further columns of clashing names."""

    def make(rows):
        names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
        full = [(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(CLASHES))) for i, t in rows]
        shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame(full, shape).select(*[f"`{n}`" for n in names])

    return make


@pytest.fixture
def odd():
    """Rows every operator must take: nulls, blanks, one endless word, repeated rows."""
    return [(None, "no id at all"), (9001, None), (9002, ""), (9003, " \n\t \n"), (9004, "x" * 150_000),
            (9005, "short"), (9005, "short"), (None, None)]
