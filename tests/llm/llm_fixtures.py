"""Fixtures of these tests; modules import what they use."""

import pytest

#: Columns named like those the operators use inside.
CLASHING = ["key", "size", "words", "hash", "band", "group", "rows", "tag", "word", "t", "kind", "kept", "n", "source_no", "block", "range", "spans", "times", "component", "digest"]

ODD_DOCUMENTS = [
    (1, "the quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \t\n\x0b\f\r ", "", "b", 0),
    (6, "one", "en", "b", 3),
    (7, "one two  three\n\nfour <|endoftext|> five", "en", "b", 3),
    (8, " ".join(f"w{i}" for i in range(30_000)), "fr", "a", 9),
    (9, "x" * 60_000, "fr", "c", 9),
    (10, "É Straße ΑΣ İ \U0001f600 \x00 \x85 　 日本", "xx", "c", 9),
    (10, "a repeated key with another text", "xx", "c", 9),
    (11, "a repeated row", "xx", "c", 9),
    (11, "a repeated row", "xx", "c", 9),
    (None, "a row without a key", "xx", "c", 9),
    (12, "mail me at a.b@c.example.org or +1 (743) 555-3824, card 4532 0151 1283 0366, host 10.0.0.255", "en", "a", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated keys and rows, and extra columns whose names clash."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD_DOCUMENTS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (3, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(table):
    """The documents of the smallest scale, as rows."""
    return [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
