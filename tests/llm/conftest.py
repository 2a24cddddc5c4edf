"""Documents for the operators of this subpackage: the small table, and one with every odd case."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick fox of the north was seen by a hunter in the old forest and the hunter went home to tell it to all who would listen "


def odd_rows():
    long_text = " ".join(f"word{i % 977} and the item{i % 331} of" for i in range(9000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4), (4, PROSE * 3, "en", "b", 1), (5, PROSE * 3, "en", None, 1), (5, PROSE * 3, "en", None, 1),
        (6, "one", "en", "c", 3), (7, "one two", None, "c", 7), (8, long_text, "en", "b", len(long_text)), (9, "naïve Straße 東京 é́ \U0001f600 mail me@host.example.org now", "de", "é", 30),
        (None, "a row without an id " * 12, "en", "a", 1), (None, None, None, None, None), (12, PROSE * 2 + "an ending of its own that nobody else has " + PROSE, "en", "\U0001f600", 5),
        (13, "<|endoftext|> is text here and there\x1c too", "en", "d", 9), (14, "x" * 5000, "en", "d", 5000), (15, "Ab aB AB ab " * 60, "en", "d", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clashing(docs):
    """docs with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("size", "score", "spans", "cid", "part", "_key", "_rest", "h", "kept", "target", "n", "d", "t", "a.b", "_t", "rejected_by")})
