import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """A table with the columns of documents from ``(doc_id, text[, lang])`` rows, and extra ones
    whose names clash with the operators' own."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("shard", T.StringType()),
        T.StructField("row", T.StringType()),
    ])

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", None, None, 1, "x", None) for r in rows
        ]
        return spark.createDataFrame(full, schema)

    return make
