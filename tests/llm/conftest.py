import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A small documents table of the given (doc_id, text), with a column whose name clashes with those inside."""
    def make(rows):
        given = [(i, t, f"extra {k}") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(given, "doc_id long, text string, _id string").withColumnRenamed("_id", "raw")
    return make


#: Nulls in either column, empty and long texts, ties and repeated rows, texts that differ in case only.
AWKWARD = [
    (1, "Hello big World"), (2, "hello BIG world"), (2, "hello BIG world"), (2, "Hello big World"), (3, None), (4, ""),
    (5, "É is not é"), (6, "é is not é"), (None, "hello big world"), (7, "word " * 40_000), (8, "word " * 40_000),
    (9, "x" * 100_000), (None, None), (10, " \t\n "), (11, "only"), (12, "漢字 😀 text"), (13, "Only"),
]


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD)
