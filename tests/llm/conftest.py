import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Rows as a stored table, as the operators read them."""
    count = iter(range(100))

    def make(rows, schema="doc_id long, text string"):
        path = str(tmp_path / f"t{next(count)}")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Nulls, empty and long texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, None), (4, "word " * 20_000), (4, "word " * 20_000), (5, "é" * 3000), (6, "a"), (6, "b"), (None, "a")]


@pytest.fixture
def odd():
    return ODD
