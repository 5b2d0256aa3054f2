import pytest

WEIRD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null key here"), (None, None),
    (5, "word " * 3000), (6, "ünï cödé ÉTÉ\r\nzwei"), (7, "a b c d e f g\n" * 40), (8, "a b c d e f g\n" * 40),
]


@pytest.fixture
def weird(spark):
    """Nulls, empty, blank, very long and repeated texts, ties and repeated rows."""
    return spark.createDataFrame(WEIRD, "doc_id long, text string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
