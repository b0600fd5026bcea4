"""Training rows under a bound keep every class learnable."""

from collections import Counter

from pyspark.sql import functions as F

from casebook.operators import classify as c


def test_rare_classes_of_both_levels_stay(spark):
    rare = F.when(F.col("doc_id") < 300, F.concat(F.lit("rare"), (F.col("doc_id") / 3).cast("int")))
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "tiny").otherwise("big").alias("one"),
    ).withColumn("two", F.coalesce(rare, F.lit("common")))
    s = c.Settings(train_rows=600)
    kept = c.bounded_rows(rows, "one", s, "two")
    assert kept.columns == rows.columns
    counts = Counter((r["one"], r["two"]) for r in kept.collect())
    full = Counter((r["one"], r["two"]) for r in rows.collect())
    assert set(counts) == set(full)
    assert all(counts[k] >= min(n, c.LEAST_ROWS) for k, n in full.items())
    assert 450 < counts[("big", "common")] < 700
    single = Counter(r["one"] for r in c.bounded_rows(rows, "one", s).collect())
    assert single["tiny"] == 2 and 450 < single["big"] < 750
