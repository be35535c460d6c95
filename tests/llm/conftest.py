import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "no id here at all"),
    (4, "one"),
    (5, "x" * 50_000),
    (6, "word " * 30_000),
    (7, "tie tie tie"),
    (7, "tie tie tie"),
    (8, "Ünï cödé  日本語 \x1c 😀"),
]


@pytest.fixture
def odd():
    return list(ODD)
