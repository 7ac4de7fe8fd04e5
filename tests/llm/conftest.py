import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, more=""):
        data = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows
        ]
        return spark.createDataFrame(data, DOCUMENT)

    return build


# Nulls, empty and blank texts, ties, repeated rows, a long text.
@pytest.fixture(scope="session")
def odd_rows():
    long = "alpha beta gamma delta " * 3000
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, "one two three"),
        (None, None),
        (4, "one two three"),
        (5, "one two three"),
        (5, "one two three"),
        (6, long),
        (7, "Ä ö — é\x00x"),
    ]
