"""Arrow batches are bounded by bytes, so that a worker's memory does not grow with the rows of a task."""

import pytest
from pyspark.sql import functions as F

from casebook.operators import lexicon, tfidf
from casebook.sources import staging

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_terms_are_counted_in_small_batches(spark, monkeypatch):
    def sized(bigrams):
        def found(batches):
            import uuid

            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict(
                    {"term": [uuid.uuid4().hex], "df": [batch.nbytes], "cf": [batch.num_rows]})

        return found

    spark.conf.unset(LIMIT)
    monkeypatch.setattr(tfidf, "_summer", sized)
    docs = spark.range(2000, numPartitions=1).select(F.array_repeat(F.lit("somewhat long"), 1500).alias("t"))
    rows = tfidf.term_statistics(docs, "t").collect()
    assert sum(r["cf"] for r in rows) == 2000
    assert max(r["df"] for r in rows) <= 1.25 * staging.BATCH_BYTES


@pytest.mark.parametrize("hot_tokens", [1, 100])
def test_lemmas_are_looked_up_in_small_batches(spark, hot_tokens):
    spark.conf.unset(LIMIT)
    docs = spark.createDataFrame([(1, ["cats", "dogs", "cat"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame(
        [("cats", 2, "cat"), ("dogs", 1, "dog"), ("cat", 1, "cat")], "token string, n long, lemma string")
    out = lexicon.lemmatise(docs, staging.stage(words, "lexicon"), hot_tokens=hot_tokens)
    assert spark.conf.get(LIMIT) == f"{staging.BATCH_BYTES}b"
    assert out.first()["tokens"] == ["cat", "dog", "cat"]
