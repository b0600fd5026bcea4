"""Invariants of the two-level classifier on the smallest tables."""

from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from casebook.operators import classify as c, evaluate, sampling, voting
from casebook.plans import triage
from casebook.plans.prepare import prepare
from casebook.sources import standin

QUICK = c.Settings(max_iter=5, folds=2, calibration_folds=2)


@pytest.fixture(scope="module")
def prepared(spark, folder):
    return prepare(standin.narratives(spark, folder), max_features=300)


def frame(spark, labels):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()),
         T.StructField("features", VectorUDT())]
    )
    shift = {k: i for i, k in enumerate(sorted(set(labels)))}
    data = [
        (i, k, Vectors.dense([1.0 + shift[k] + 0.01 * i, 2.0 - shift[k] + 0.02 * (i % 5)]))
        for i, k in enumerate(labels)
    ]
    return spark.createDataFrame(data, schema)


def sums_to_one(df, column, width):
    return all(
        len(r[0]) == width and abs(sum(r[0]) - 1) < 1e-9 and min(r[0]) >= 0
        for r in df.select(column).collect()
    )


def test_votes(spark):
    df = spark.createDataFrame(
        [([0.2, 0.4, 0.4], [0.6, 0.2, 0.2], ["a", "b", "c"])],
        "p array<double>, q array<double>, k array<string>",
    )
    r = df.select(
        voting.argmax_label(F.col("p"), F.col("k")).alias("first"),
        voting.soft_vote(F.col("p"), F.col("q")).alias("mean"),
        voting.joint_confidence(F.col("p"), F.col("q")).alias("joint"),
    ).first()
    assert r.first == "b" and r["mean"] == pytest.approx([0.4, 0.3, 0.3]) and r.joint == 0.24


def test_preparation(prepared):
    train, test = prepared.train, prepared.test
    assert not {r[0] for r in train.select("source_doc_id").collect()} & {
        r[0] for r in test.select("doc_id").collect()
    }
    assert train.where("is_augmented").count() > 0 and test.where("is_augmented").count() == 0
    assert train.select("doc_id").distinct().count() == train.count()
    size = prepared.vocabulary.count()
    assert {r.features.size for r in test.collect()} == {size} and size <= 300


def test_three_classes(spark):
    df = frame(spark, ["a"] * 12 + ["b"] * 8 + ["c"] * 6).cache()
    model = c.fit_ensemble(df, "label", QUICK)
    scored = model.add_probabilities(df, "p")
    assert model.classes == ["a", "b", "c"] and len(model.models) == 2
    assert sums_to_one(scored, "p", 3)
    hits = scored.where(voting.argmax_label(F.col("p"), model.class_array()) == F.col("label"))
    assert hits.count() > 20


def test_two_classes_share_one_calibrator(spark):
    df = frame(spark, ["a"] * 9 + ["b"] * 7)
    model = c.fit_calibrated_svc(df, "label", QUICK)
    assert all(len(m) == 1 for m in model.members)
    assert sums_to_one(model.add_probabilities(df, "p"), "p", 2)


def test_small_classes(spark):
    single = c.fit_ensemble(frame(spark, ["a"] * 4), "label", QUICK)
    assert single.models == [] and single.classes == ["a"]
    lonely = c.fit_ensemble(frame(spark, ["a"] * 6 + ["b"]), "label", QUICK)
    assert [type(m) for m in lonely.models] == [c.Logistic]
    pair = c.fit_ensemble(
        frame(spark, ["a"] * 6 + ["b"] * 2), "label", c.Settings(max_iter=5, calibration_folds=3)
    )
    assert len(pair.models[1].members) == 2


def test_class_weights(spark):
    df = frame(spark, ["a"] * 3 + ["b"])
    got = {r.label: r.weight for r in c.class_weights(df, "label").collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": 2.0}


def test_out_of_fold_never_sees_its_rows(spark):
    df = frame(spark, ["a"] * 6 + ["b"] * 6)
    folded = sampling.with_folds(df, "doc_id", "label", 2).cache()
    seen = []

    def fit(part, label, s):
        seen.append({r.doc_id for r in part.collect()})
        return c.fit_one("logistic")(part, label, s)

    got = c.out_of_fold(folded, "label", QUICK, fit)
    assert Counter(r.doc_id for r in got.collect()) == Counter(range(12))
    assert sums_to_one(got, "p1", 2)
    assert len(seen) == 2 and not seen[0] & seen[1]


def test_grid_search_takes_the_first_best(spark):
    df = frame(spark, ["a"] * 8 + ["b"] * 8)
    folded = sampling.with_folds(df, "doc_id", "label", 2).cache()
    result = c.grid_search(folded, "label", c.fit_one("logistic"), [0.1, 1.0], QUICK)
    scores = {r.c: r.mean_macro_f1 for r in result.scores.collect()}
    assert result.best == max([0.1, 1.0], key=lambda x: scores[x])


@pytest.mark.parametrize("score", ["joint", "level2"])
def test_cascade(prepared, score):
    train = prepared.train.where("broad_group is not null")
    test = prepared.test.where("broad_group is not null")
    run = c.two_level(train, test, "broad_group", "sub_issue_group", QUICK, score)
    rows = run.predictions.cache()
    assert Counter(r.doc_id for r in rows.collect()) == Counter(
        r.doc_id for r in test.select("doc_id").collect()
    )
    assert all(0 < r.conf <= 1 for r in rows.collect())
    tables = triage.report(run, "broad_group", "sub_issue_group", ["a", "b"])
    sweep = [r.review_pct for r in tables.sweep.orderBy("threshold").collect()]
    assert sweep == sorted(sweep)
    assert tables.level1_confusion.agg(F.sum("n")).first()[0] == rows.count()


def test_cascade_with_grids(prepared):
    run = triage.issue_cascade(prepared, QUICK, grid1=[0.1, 1.0], grid2=[1.0])
    assert run.predictions.count() == prepared.test.count()
    alternative = triage.alternative_level1(prepared, QUICK)
    assert alternative.count() == prepared.test.count()
    counts = evaluate.outcomes(alternative, "y_true", "pred1")
    assert 0 <= evaluate.macro_f1(counts).first()[0] <= 1
