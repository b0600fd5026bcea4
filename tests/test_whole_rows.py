"""Model queries train on every labelled row; neither driver nor tasks hold a whole stack of fits."""

import random
from types import SimpleNamespace
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from casebook.operators import classify as c, newton, sampling, stacked
from casebook.operators.taxonomy import BROAD_GROUPS
from casebook.plans import catalog

MANY = 20_500


class Reached(Exception):
    pass


@pytest.fixture(scope="module")
def many(spark):
    """More labelled rows than model queries once trained on."""
    groups = sorted(BROAD_GROUPS)[:2]
    label = F.when(F.col("doc_id") % 2 == 0, groups[0]).otherwise(groups[1])
    return spark.range(MANY).withColumnRenamed("id", "doc_id").withColumns({
        "issue_group": label, "sub_issue_group": label, "broad_group": label,
        "is_augmented": F.lit(False)}).cache()


@pytest.mark.parametrize("name", [
    "level1_lr_checks", "level1_svc_checks", "grid_search", "grid_search_checks", "out_of_fold_checks",
    "level2_cascade_checks", "cascade_sweep", "cascade_pairs", "cascade_confusion_checks",
    "issue_cascade", "issue_cascade_checks", "alt_grouping_checks", "run_summary",
])
def test_fits_see_every_row(monkeypatch, many, name):
    seen = []

    def fit(train, label, *args, **kw):
        seen.append(train.where(F.col(label).isNotNull()).count())
        raise Reached

    monkeypatch.setattr(catalog, "_prepared", lambda spark, folder: SimpleNamespace(train=many, test=many))
    monkeypatch.setattr(catalog, "_files", lambda spark, folder: ("whole", folder))
    monkeypatch.setattr(c, "fit_level", fit)
    with pytest.raises(Reached):
        catalog.QUERIES[name](None, "folder")
    assert seen == [MANY]


# --- bounds -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(8)
    rows = []
    for i in range(90):
        places = sorted(rng.sample(range(12), 5))
        values = [rng.gauss(0.6 * (p % 3 == i % 3), 0.5) for p in places]
        rows.append((i, "abc"[i % 3], Vectors.sparse(12, places, values)))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()),
        T.StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_coefficients_are_read_in_turns(frame, monkeypatch):
    """A grid's models are scored a few at a time, with the scores of all at once."""
    folded = sampling.with_folds(frame, "doc_id", "label", 2)
    s, grid = c.Settings(folds=2), [0.1, 1.0]
    once = c.fit_level(folded, "label", s, grid, fold="fold")
    most, reads, read = 13 * 8 * 12, [], newton.Coefficients.read

    def noted(stored, numbers):
        found = read(stored, numbers)
        reads.append(sum(w.nbytes for w in found.values()))
        return found

    monkeypatch.setattr(newton.Coefficients, "read", noted)
    monkeypatch.setattr(stacked, "STACK_BYTES", most)
    level = c.fit_level(folded, "label", s, grid, fold="fold")
    assert len(reads) > 3 and 0 < max(reads) <= most
    assert not any(x.stored._held for x in level.solutions.values())
    assert sum(x.problem.columns for x in level.solutions.values()) * 13 * 8 > 5 * most
    rows = [sorted(x.scores.drop("best").collect()) for x in (once, level)]
    assert [r[:3] for r in rows[0]] == [r[:3] for r in rows[1]]
    assert [r[3] for r in rows[0]] == pytest.approx([r[3] for r in rows[1]])
    assert once.best == level.best


def test_blocks_and_row_groups_are_small(frame, monkeypatch):
    """Cells bound a block, and few blocks are written and read together."""
    monkeypatch.setattr(newton, "BLOCK_CELLS", 13)
    rows = frame.coalesce(1).select(
        F.lit(0).alias("g"), F.lit(0).alias("y"), F.lit(-1).alias("fold"),
        F.array(F.lit(-1)).alias("cal"), "features")
    blocks = newton.pack(rows, 12)
    found = blocks.collect()
    assert sum(r["n"] for r in found) == 90 and max(r["n"] for r in found) == 2
    assert all(r["cells"] == 6 * r["n"] for r in found)
    groups = []
    for f in blocks.inputFiles():
        meta = pq.ParquetFile(urlparse(f).path).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) == len(found) and max(groups) <= 16


def test_repeated_ids_are_calibrated(frame):
    """Rows that share an id share their parts; none is lost and none is doubled."""
    twice = frame.unionByName(frame)
    level = c.fit_level(twice, "label", c.Settings())
    rows = level.rows.collect()
    assert len(rows) == 180 and ("svc", 0, 0, 1.0) in level.fits
    parts = {}
    for r in rows:
        assert parts.setdefault(r["doc_id"], r["_cal"][0]) == r["_cal"][0]


def test_cascade_features_carry_no_names(frame):
    """A name for each of the vocabulary's terms would lie on the driver with every frame."""
    rows = frame.withColumn("p1", F.array(F.lit(0.25), F.lit(0.75)))
    joined = c.with_cascade_features(rows)
    assert joined.schema["features"].metadata == {}
    first = joined.first()
    assert len(first["features"]) == 14 and list(first["features"].toArray()[-2:]) == [0.25, 0.75]


def test_products_leave_out_rows_beyond_the_margin(monkeypatch):
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(60, 5)) + np.where(np.arange(60) % 2, 1.5, -1.5)[:, None]
    block = newton.Block._of(
        0, newton.Sparse(
            np.arange(0, 361, 6), np.tile(np.arange(6, dtype=np.int32), 60),
            np.column_stack([dense, np.ones(60)]).ravel()),
        (np.arange(60) % 2).astype(np.int32), np.full(60, -1, np.int32), np.zeros((60, 1), np.int16))
    sizes, times = [], newton.Sparse.times
    monkeypatch.setattr(newton.Sparse, "times", lambda s, m: sizes.append(len(s)) or times(s, m))
    p = newton.Problem(("p",), 0, "hinge", 1.0, (1.0, 1.0), target=1)
    fit = newton._Fit(p, 5, 1e-9, 100)
    newton._fitted(fit, block, 5)
    x, t = np.column_stack([dense, np.ones(60)]), np.where(np.arange(60) % 2, 1.0, -1.0)
    w = fit.w[:, 0]
    gradient = w - 2 * x.T @ (t * np.maximum(1 - t * (x @ w), 0))
    assert np.abs(gradient).max() < 1e-6 and min(sizes) < 30 < max(sizes)
