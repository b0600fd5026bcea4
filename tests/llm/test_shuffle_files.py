"""What stays on the executors' disks and in the shared folder."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import lm_score
from casebook.sources import staging


def shuffles(spark, most=None):
    """Names of the shuffle files on disk; Spark may take a moment to bring them down to ``most``."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        files = disk.getAllFiles().mkString("\n").split("\n")
        found = {f for f in files if "/shuffle_" in f and f.endswith(".data")}
        if most is None or len(found) <= most:
            break
        time.sleep(0.1)
    return found


@pytest.mark.parametrize("setting", ["false", "true"])
def test_a_staged_table_leaves_no_shuffle_files(spark, setting):
    before = shuffles(spark)
    spark.conf.set(staging.SHUFFLES_END, setting)
    try:
        rows = spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(4, "k")
        staged = staging.stage(rows.groupBy("k").count().join(rows.distinct(), "k"), "counts")
        assert spark.conf.get(staging.SHUFFLES_END) == setting
    finally:
        spark.conf.unset(staging.SHUFFLES_END)
    assert not shuffles(spark, len(before)) - before
    assert sum(r["count"] for r in staged.collect()) == 1000


def test_one_length_of_gram_is_shuffled_at_a_time(spark, documents, monkeypatch):
    before, staged = shuffles(spark), []

    def watched(df, name):
        out = staging.stage(df, name)
        staged.append((name, shuffles(spark, len(before) + 8) - before))
        return out

    monkeypatch.setattr(lm_score, "stage", watched)
    lm_score.score(documents([(i, f"a b c{i % 3} d") for i in range(20)]), 3)
    assert staged[0][0] == "segments" and [n for n, _ in staged[1:]] == ["answers"] * 3
    # The sum of all words may stay, grams do not.
    assert not staged[0][1] and staged[3][1] <= staged[1][1] and len(staged[1][1]) <= 8


def test_a_stage_leaves_only_the_keys_it_drops(spark, documents, folder):
    shared = Path(staging.run_folder(spark))
    text = " ".join(f"w{i}" for i in range(60))
    rows = documents([(1, text), (2, text + " x"), (3, text), (4, "another text"), (None, text)])
    left = []
    for function, want in [
        (corpus_pipeline.exact, ["exact", "out", "repeated"]), (corpus_pipeline.near, ["out"]),
        (corpus_pipeline.decontaminate, ["out"]),
    ]:
        before = set(shared.glob("*/*"))
        out = function(spark, rows, folder)
        assert sorted(p.name for p in set(shared.glob("*/*")) - before) == want
        left.append(sorted(r["doc_id"] or 0 for r in out.collect()))
    # The row without an id is a group's member like any other in exact dedup alone.
    assert left == [[1, 2, 4], [0, 1, 4], [0, 1, 2, 3, 4]]
