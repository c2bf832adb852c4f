"""Fixtures of these tests, imported by name (the session comes from the conftest above)."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    extra columns named like outputs."""
    rows = [(1, "one two three four five six seven", "en", "a", 33, "x", "y"),
            (1, "one two three four five six seven", "en", "a", 33, "x", "y"),
            (2, None, None, None, None, None, None), (3, "", "en", "b", 0, None, None),
            (4, "   \n\t ", "de", "b", 6, None, None), (None, "one two three four five six seven", None, None, None, None, None),
            (None, None, None, None, None, None, None), (5, LONG, "en", "c", len(LONG), None, None),
            (6, LONG, "fr", "c", len(LONG), None, None), (7, "ein kurzer text über nichts", "de", "a", 27, None, None),
            (8, "idiot \U0001F600 你好 password = \"s3cr3tvalue99\" mail a.b@c.example.org", "en", "d", 60, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
