"""Places where an operator once did less than its whole job."""

import hashlib

import pytest
from compare import connect, difference

import __spark_entry__ as entry
import corpus_pipeline
from casebook.llm import lm_score, phrase_index


def test_order_three_is_registered(spark, folder):
    name = "op9_lm_scoring"
    assert lm_score.ORDER == 3 and not [n for n in entry.queries() if n.startswith(name + "_")]
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert difference(spark, connect(folder), folder, query, sql) is None


@pytest.mark.parametrize("block", [20_000, 1])
def test_repeated_item_ids_count_once(spark, documents, monkeypatch, block):
    monkeypatch.setattr(phrase_index, "ITEMS_PER_BLOCK", block)
    benchmark = spark.createDataFrame(
        [("a", "red blue"), ("a", "red blue"), ("a", "green"), ("b", "green")],
        "item_id string, text string")
    rows = documents([(1, "red blue green"), (2, "red blue"), (3, "none")])
    found = {r["doc_id"]: r for r in phrase_index.contamination(
        phrase_index.matches(rows, benchmark)).collect()}
    assert [found[i]["n_items"] for i in (1, 2, 3)] == [2, 1, 0]
    assert [found[i]["n_hit"] for i in (1, 2, 3)] == [3, 2, 0]
    assert found[1]["items_sha256"] == hashlib.sha256(b"a,b").hexdigest()
    assert found[2]["items_sha256"] == hashlib.sha256(b"a").hexdigest()


def test_rows_that_share_an_id_are_judged_by_text(spark, documents, tmp_path):
    near = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(13))
    rows = documents([
        (1, near), (2, near + " x"), (2, "clean text of its own"), (3, other), (3, other + " y"),
        (4, passage), (4, "nothing of the benchmark"), (None, near + " z")])
    left = corpus_pipeline.near(spark, rows, "").collect()
    kept = {(r["doc_id"], r["text"]) for r in left}
    assert (2, "clean text of its own") in kept and (1, near) in kept
    assert (2, near + " x") not in kept and (None, near + " z") in kept
    assert len([r for r in left if r["doc_id"] == 3]) == 1
    spark.createDataFrame([("7", passage)], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontaminate(spark, rows, str(tmp_path)).collect()
    assert {r["text"] for r in clean if r["doc_id"] == 4} == {"nothing of the benchmark"}
    assert len(clean) == 7
