import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) or longer rows; what is missing is null."""

    def make(*rows, schema=DOCUMENTS):
        width = len(schema.split(","))
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null and empty texts, null ids, repeated rows, ties, a very long word and a very long text."""
    return docs(
        (1, None), (2, ""), (3, " \t\n"), (None, "a text without an id that is long enough to count"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "one two three four five six seven"),
        (7, "x" * 70_000), (8, "word soup " * 20_000), (9, "é𝛼日本   \x1c it's"), (10, "alone"),
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
