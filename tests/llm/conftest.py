import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "s", 45),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "s", 45),
    (3, "", "en", None, 0),
    (4, None, None, None, None),
    (5, "one", "fr", "s", 3),
    (6, "one two", "de", "s", 7),
    (7, "one", "fr", "s", 3),
    (7, "one", "fr", "s", 3),
    (None, "a row without an id", "en", "s", 19),
    (None, "another row without an id", None, "s", 25),
    (8, "\t \n\x0b ", "en", "s", 5),
    (9, "Größe ñandú ÀÉ x" * 3, "de", "s", 48),
    (10, "z" * 5000, "en", "s", 5000),
    (11, "long text of many words\nand lines " * 3000, "en", "s", 100),
    (12, "Don't stop: it's <|endoftext|> here now ΣΣ こん 12 3!!", "en", "s", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", kept_text string, component_id int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
