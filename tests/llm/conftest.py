import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs or longer tuples, with a column that clashes."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(*row, *("en", "web", None)[len(row) - 2 :]) for row in rows]
        return spark.createDataFrame(full, DOCS).repartition(3, "text").withColumn("key", F.lit("own"))

    return make
