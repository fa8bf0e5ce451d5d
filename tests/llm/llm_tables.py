import pytest


@pytest.fixture()
def table(spark):
    """Rows as a ``documents`` table with a clashing extra column, in several partitions."""
    def make(rows, parts=3):
        df = spark.createDataFrame(
            [(i, t, "en", f"src{n % 3}", 7, "x") for n, (i, t) in enumerate(rows)],
            "doc_id long, text string, lang string, source string, kept int, _size string")
        return df.repartition(parts)
    return make


SF01 = "/root/testdata/sf0.01"
