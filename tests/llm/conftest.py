import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) pairs, with columns whose names clash with internal ones."""

    def make(rows):
        kept = [(i, t, "en", "src0", None if t is None else len(t), "fp", 1, "kept", [1]) for i, t in rows]
        return spark.createDataFrame(kept, DOCUMENT + ", fp string, part int, mark string, runs array<int>")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor " * 20_000
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one"), (7, "one two"), (7, "one two"), (7, "three"),
        (None, "one two three four"), (None, None), (8, "Ünï ẞ İstanbul 中文 \x1c　 it's"), (9, "x" * 70_000),
    ]
