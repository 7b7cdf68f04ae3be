import pytest

EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"),
    (7, "ONE two\nthree four five six\n\nseven"), (8, "é ß 漢字 😀 ́x " * 40), (9, "w" * 60_000), (10, "1" * 3000 + " +1 555 123 4567 a@b.co"),
    (10, "1" * 3000 + " +1 555 123 4567 a@b.co"), (None, "no id at all but some words here"), (11, "\x00 \x1f\x85\xa0 x</s>[INST]\\ y"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing
    names."""
    rows = [(i, t, "en", i, "k", 0.5, 3) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key long, h string, salt double, n_words int")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
