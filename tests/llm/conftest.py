import pytest

from . import brute


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd_rows():
    return brute.documents()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd documents, with extra columns that clash with names the operators make."""
    rows = [(d, t, f"s{i % 3}" if i % 4 else None, i) for i, (d, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_words int").repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
