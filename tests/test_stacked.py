"""Stacked fits: against brute force, separate fits and both ways of dealing the work."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from casebook.operators import classify as c, evaluate, isotonic, newton, sampling, stacked, voting

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("grp", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("features", VectorUDT()),
])
EXACT = c.Settings(tol=1e-9, folds=3)


@pytest.fixture(scope="module")
def rows():
    """Sparse rows of three classes that overlap, in two groups."""
    rng = random.Random(5)
    out = []
    for i in range(150):
        label = "abc"[i % 3] if i % 7 else "a"
        places = sorted(rng.sample(range(12), 5))
        values = [rng.gauss(0.4 * (p % 3 == "abc".index(label)), 0.5) for p in places]
        out.append((i, "xy"[i % 5 == 0], label, Vectors.sparse(12, places, values)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def dense(rows):
    return np.array([[*r[3].toArray(), 1.0] for r in rows]), np.array([r[2] for r in rows])


def test_squared_hinge_equals_plain_newton_on_fifty_rows(spark, rows):
    """Strictly convex, so any other solver must end at the same place."""
    some = rows[:50]
    level = c.fit_level(spark.createDataFrame(some, SCHEMA), "label", EXACT)
    x, labels = dense(some)
    checked = 0
    for key, found in level.solutions.items():
        if key[0] != "svc":
            continue
        p = found.problem
        names = level.classes[0]
        cal = {r["doc_id"]: r["_cal"][0] for r in level.rows.collect()}
        mine = np.array([cal[r[0]] % p.parts != p.part for r in some])
        t = np.where(labels == names[p.target], 1.0, -1.0)
        weight = np.array([p.weights[names.index(y)] for y in labels]) * mine
        w = np.zeros(13)
        for _ in range(200):
            gap = np.maximum(1 - t * (x @ w), 0)
            gradient = w - 2 * p.c * x.T @ (weight * t * gap)
            bend = np.eye(13) + 2 * p.c * (x * (weight * (gap > 0))[:, None]).T @ x
            w = w - np.linalg.solve(bend, gradient) * 0.7
        assert np.abs(gradient).max() < 1e-9
        assert np.abs(found.w[:, 0] - w).max() < 1e-6
        assert found.gradient < 1e-6
        checked += 1
    assert checked == 9


@pytest.mark.parametrize("labels", ["abc", "ab"])
def test_logistic_gradient_vanishes(frame, labels):
    some = frame.where(F.col("label").isin(*labels))
    level = c.fit_level(some, "label", EXACT, models=("logistic",))
    w = level.fits["logistic", 0, 0, 1.0].w
    x, y = dense(some.collect())
    weights = {k: len(y) / (len(labels) * (y == k).sum()) for k in labels}
    z = x @ w if len(labels) > 2 else np.column_stack([np.zeros(len(x)), x @ w])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    hit = np.array([[v == k for k in labels] for v in y])
    gradient = x.T @ ((p - hit) * np.array([weights[v] for v in y])[:, None])
    gradient = gradient if len(labels) > 2 else gradient[:, 1:]
    gradient[:-1] += w[:-1]
    assert np.abs(gradient).max() < 1e-6


def test_passes_as_jobs_equal_dealt_problems(spark, frame, monkeypatch):
    """Rows that stay where they are give the same fits, also in turns and slices."""
    folded = sampling.with_folds(frame, "doc_id", "label", 3)
    few = c.Settings(tol=1e-6, folds=3)
    dealt = c.fit_level(folded, "label", few, [0.1, 1.0], group="grp", fold="fold")
    monkeypatch.setattr(newton, "LOCAL_BYTES", -1)
    monkeypatch.setattr(newton, "STACK_BYTES", 13 * 8 * 90)
    monkeypatch.setattr(newton, "_SLICE_BYTES", 13 * 8 * 20)
    monkeypatch.setattr(newton, "BLOCK_ROWS", 9)
    stayed = c.fit_level(folded, "label", few, [0.1, 1.0], group="grp", fold="fold")
    assert dealt.solutions.keys() == stayed.solutions.keys()
    for key, one in dealt.solutions.items():
        assert np.abs(one.w - stayed.solutions[key].w).max() < 1e-4


def test_grid_scores_and_out_of_fold_equal_separate_fits(frame):
    folded = sampling.with_folds(frame, "doc_id", "label", 3).cache()
    level = c.fit_level(folded, "label", EXACT, [0.05, 1.0], fold="fold")
    for kind in ("logistic", "svc"):
        apart = c.grid_search(folded, "label", c.fit_one(kind), [0.05, 1.0], EXACT)
        want = {r["c"]: r["mean_macro_f1"] for r in apart.scores.collect()}
        own = level.scores.where(F.col("model") == kind)
        got = {r["c"]: r["mean_macro_f1"] for r in own.collect()}
        assert got == pytest.approx(want, abs=1e-4)
        assert level.best[kind, 0] == apart.best
    level.best = {("logistic", 0): 1.0, ("svc", 0): 1.0}
    apart = c.out_of_fold(folded, "label", EXACT)  # every part by models without its fold
    want = {r["doc_id"]: r["p1"] for r in apart.collect()}
    got = {r["doc_id"]: r["p1"] for r in level.out_of_fold("p1").collect()}
    assert want.keys() == got.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-4)


def test_groups_equal_fits_of_their_own(frame):
    together = c.fit_level(frame, "label", EXACT, group="grp")
    assert together.groups == ["x", "y"]
    for g, name in enumerate(together.groups):
        alone = c.fit_level(frame.where(F.col("grp") == name), "label", EXACT)
        for key, one in alone.solutions.items():
            same = together.solutions[(key[0], g, *key[2:])]
            assert np.abs(one.w - same.w).max() < 1e-5
    p = together.add_probabilities(frame, "p").select("doc_id", "grp", "p").collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == 3 for r in p)


def test_fits_beat_the_majority(frame):
    model = c.fit_ensemble(frame, "label", c.Settings())
    told = model.add_probabilities(frame, "p").select(
        F.col("label").alias("y_true"),
        voting.argmax_label(F.col("p"), model.class_array()).alias("y_pred"))
    guess = told.withColumn("y_pred", F.lit("a"))
    ours, base = (evaluate.macro_f1(evaluate.outcomes(x)).first()[0] for x in (told, guess))
    assert ours > base + 0.2


def test_single_classes_and_tiny_groups(spark):
    data = [(i, g, k, Vectors.dense([1.0 * i, 1.0])) for i, (g, k) in enumerate(
        [("one", "a")] * 4 + [("lone", "a")] * 5 + [("lone", "b")] + [("two", "a"), ("two", "b")] * 2)]
    level = c.fit_level(spark.createDataFrame(data, SCHEMA), "label", c.Settings(), group="grp")
    models = {level.groups[g]: [type(m).__name__ for m in level.ensemble(g).models] for g in range(3)}
    assert models == {"one": [], "lone": ["Logistic"], "two": ["Logistic", "CalibratedSvc"]}
    with pytest.raises(ValueError):
        c.fit_level(spark.createDataFrame(data, SCHEMA), "label", c.Settings(), [1.0])


# --- isotonic -----------------------------------------------------------------------------------


def brute_isotonic(points):
    """Greatest-lower-left means: the value at i is max over a <= i of min over b >= i of mean(a..b)."""
    scores = sorted({s for s, _, _ in points})
    weight = [sum(w for s, _, w in points if s == x) for x in scores]
    total = [sum(w * h for s, h, w in points if s == x) for x in scores]
    n = range(len(scores))
    return {
        scores[i]: max(
            min(sum(total[a:b + 1]) / sum(weight[a:b + 1]) for b in n if b >= i) for a in n if a <= i)
        for i in n}


@pytest.mark.parametrize("kind", ["random", "ties", "hits", "none", "rising", "falling"])
def test_isotonic_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    points = []
    for i in range(60):
        score = float(rng.randrange(8)) if kind == "ties" else rng.random()
        hit = {"hits": 1.0, "none": 0.0, "rising": float(score > 0.5), "falling": float(score < 0.5)}.get(
            kind, float(rng.random() < 0.2 + score / 12))
        points.append((score, hit, rng.choice([1.0, 2.0])))
    data = [(f, *p) for f in (3, 8) for p in points] + [(5, 0.5, 1.0, 1.0)]
    df = spark.createDataFrame(data, "fit int, score double, hit double, weight double")
    found = isotonic.curves(isotonic.fit_isotonic(df.repartition(7)))
    want = brute_isotonic(points)
    assert set(found) == {3, 5, 8}
    for f in (3, 8):
        got = np.interp(list(want), *found[f])
        assert got == pytest.approx(list(want.values()), abs=1e-12)


def test_isotonic_over_many_ranges(spark):
    """A fit that fills many ranges is pooled in rounds."""
    rng = random.Random(9)
    points = [(rng.random(), float(rng.random() < 0.5), 1.0) for _ in range(400)]
    df = spark.createDataFrame([(0, *p) for p in points], "fit int, score double, hit double, weight double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        found = isotonic.curves(isotonic.fit_isotonic(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cells = sorted(points)
    once = isotonic.pooled(*[np.array(x) for x in zip(*[(s, s, w, h * w) for s, h, w in cells])])
    assert np.allclose(found[0][1][::2], once[3] / once[2])


def test_no_rows_no_fits(spark):
    empty = spark.createDataFrame([], "fit int, score double, hit double, weight double")
    assert isotonic.curves(isotonic.fit_isotonic(empty)) == {}


def test_calibration_parts_are_stratified_for_every_mask(frame):
    folded = sampling.with_folds(frame, "doc_id", "label", 3)
    level = c.fit_level(folded, "label", c.Settings(folds=3, max_iter=1), fold="fold")
    rows = level.rows.collect()
    for mask in range(4):
        for label in "abc":
            own = [r["_cal"][mask] % 3 for r in rows
                   if r["label"] == label and r["_fold"] != mask - 1]
            sizes = [own.count(i) for i in range(3)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(own)
    assert stacked.MODELS == ("logistic", "svc")


def packed_block(n=40, width=30, seed=3):
    rng = np.random.default_rng(seed)
    dense_rows = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.2)
    places = [np.flatnonzero(r).astype(np.int32) for r in dense_rows]
    features = pa.StructArray.from_arrays(
        [pa.array([0] * n, pa.int8()), pa.array([width] * n, pa.int32()),
         pa.array(places, pa.list_(pa.int32())),
         pa.array([r[p] for r, p in zip(dense_rows, places)], pa.list_(pa.float64()))],
        ["type", "size", "indices", "values"])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), pa.array([i % 2 for i in range(n)], pa.int32()),
         pa.array([-1] * n, pa.int32()), pa.array([[-1]] * n, pa.list_(pa.int32())), features],
        ["g", "y", "fold", "cal", "features"])
    parts = [newton._packed(batch.slice(a, 13), 0, width).to_pylist()[0] for a in range(0, n, 13)]
    return np.column_stack([dense_rows, np.ones(n)]), newton.Block.merged(
        [newton.Block(p) for p in parts])


def test_merged_blocks_multiply_like_dense_rows(monkeypatch):
    x, block = packed_block()
    monkeypatch.setattr(newton, "_CELLS", 7)
    m = np.random.default_rng(1).normal(size=(31, 6))
    z = block.x.times(m)
    assert np.allclose(z, x @ m)
    out = np.zeros((31, 6))
    block.add_transposed(z, out)
    assert np.allclose(out, x.T @ (x @ m))


def test_scores_are_kept_between_products(monkeypatch):
    """A pass at hand multiplies the rows by one column, the step or its trial, never by both."""
    x, block = packed_block()
    widths, passes, times, take = [], [], newton.Sparse.times, newton._Fit.take
    monkeypatch.setattr(newton.Sparse, "times", lambda s, m: widths.append(m.shape[1]) or times(s, m))
    monkeypatch.setattr(newton._Fit, "take", lambda s, *a: passes.append(1) or take(s, *a))
    p = newton.Problem(("p",), 0, "logit", 1.0, (1.0, 1.0), target=1)
    fit = newton._Fit(p, 30, 1e-8, 100)
    newton._fitted(fit, block, 30)
    assert fit.done and sum(widths) == len(passes) > 3
    t = np.where(np.arange(40) % 2 == 1, 1.0, -1.0)
    w = fit.w[:, 0]
    gradient = np.append(w[:-1], 0) - x.T @ (t / (1 + np.exp(t * (x @ w))))
    assert np.abs(gradient).max() < 1e-6


def test_no_calibration_parts_where_no_svm_can_be_fitted(frame, monkeypatch):
    monkeypatch.setattr(stacked, "_with_parts", None)
    rare = F.when(F.col("doc_id") == 3, "rare").otherwise(F.col("label"))
    level = c.fit_level(frame.withColumn("label", rare), "label", EXACT)
    assert len(level.ensemble().models) == 1
