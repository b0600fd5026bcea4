"""Two-level classification: single models, cross-validation of any fit, and the cascade.

Frames carry ``doc_id``, a label column and ``features`` (a vector). Predictions are added as
``array<double>`` columns aligned with ``classes``, the label values in ascending order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casebook.operators.evaluate import macro_f1, outcomes
from casebook.operators.linear import CalibratedSvc, Ensemble, Logistic
from casebook.operators.sampling import with_folds
from casebook.operators.stacked import MODELS, Level, Settings, fit_level
from casebook.operators.voting import argmax_label, confidence, joint_confidence
from casebook.sources.staging import bounded, stage

# Grids of the regularisation strength.
LEVEL1_GRID = [0.01, 0.1, 0.5, 1.0]
LEVEL2_GRID = [0.1, 1.0, 5.0]

# Rows of a class that a bound on the training rows leaves at least.
LEAST_ROWS = 8

def _together(jobs: Sequence[Callable], threads: int) -> list:
    """Run independent fits at the same time; Spark interleaves their tasks."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inherit(job) for job in jobs])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- labels and weights ---------------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with the balanced weight ``rows / (classes * n)``."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = sizes.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return sizes.withColumn("weight", whole.getField("n") / (whole.getField("k") * F.col("n")))


def class_sizes(df: DataFrame, label: str, most: int = Settings.max_classes) -> dict[str, int]:
    """Class sizes on the driver, in ascending order of the class; at most ``most``."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).count()
    rows = sizes.orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return {r[0]: r[1] for r in rows}


def bounded_rows(
    train: DataFrame, label: str, s: Settings, level2: str | None = None
) -> DataFrame:
    """The labelled rows a fit may use, see ``Settings.train_rows``.

    The rows of lowest hash are told in the map tasks first: no class meets as a whole.
    """
    known = train.where(F.col(label).isNotNull())
    if s.train_rows is None:
        return known
    sizes = class_sizes(known, label, s.max_classes)
    share = s.train_rows / max(1, sum(sizes.values()))
    if share >= 1:
        return known
    place = F.pmod(F.xxhash64(s.id_column), F.lit(1 << 30)) / float(1 << 30)
    by = [F.col(label), *([F.col(level2)] if level2 else [])]
    keyed = known.select(F.struct(*by).alias("_class"), place.alias("_place"))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_place"))
    bars = stage(
        keyed.withColumn("_rank", rank).where(F.col("_rank") <= LEAST_ROWS)
        .groupBy("_class").agg(F.max("_place").alias("_bar")), "bars")
    chosen = known.withColumn("_class", F.struct(*by)).join(bounded(bars), "_class")
    return chosen.where((place < share) | (place <= F.col("_bar"))).drop("_class", "_bar")


# --- single models --------------------------------------------------------------------------


def fit_logistic(train: DataFrame, label: str, s: Settings) -> Logistic:
    """Multinomial logistic regression with balanced class weights and a free intercept."""
    level = fit_level(train, label, s, models=("logistic",))
    return level.fits["logistic", 0, 0, s.c]


def fit_calibrated_svc(train: DataFrame, label: str, s: Settings) -> CalibratedSvc:
    """Linear SVM with isotonic calibration on held-out folds, averaged over the folds.

    Squared hinge loss, penalised intercept. Weights are balanced anew in every fold. With more than
    two classes each one meets the rest: its own rows weigh its balanced weight, all others weigh 1.
    """
    level = fit_level(train, label, s, models=("svc",))
    if ("svc", 0, 0, s.c) not in level.fits:
        raise ValueError("calibration needs two classes and two rows of each")
    return level.fits["svc", 0, 0, s.c]


def fit_ensemble(train: DataFrame, label: str, s: Settings) -> Ensemble:
    """Both models. One class needs none; a class of one row leaves the SVM out."""
    return fit_level(train, label, s).ensemble()


def fit_one(kind: str) -> Callable[[DataFrame, str, Settings], Ensemble]:
    """A fit of one model alone (``logistic`` or ``svc``) that copes with tiny classes.

    One class needs no model; where a class is too small to calibrate on, the logistic
    regression stands in.
    """

    def fit(train: DataFrame, label: str, s: Settings) -> Ensemble:
        level = fit_level(train, label, s, models=("logistic",) if kind == "logistic" else MODELS)
        return level.alone(kind, 0, 0, s.c)

    return fit


def _aligned(p: str, own: Sequence[str], classes: Sequence[str]) -> Column:
    """Probabilities over ``classes``; a class the model never saw has probability 0."""
    place = {c: i for i, c in enumerate(own)}
    return F.array(*[F.col(p)[place[c]] if c in place else F.lit(0.0) for c in classes])


# --- cross-validation -----------------------------------------------------------------------


def out_of_fold(
    folded: DataFrame, label: str, s: Settings, fit: Callable = fit_ensemble,
    out: str = "p1", fold: str = "fold",
) -> DataFrame:
    """Add probabilities to every training row by models that never saw its fold."""
    classes = list(class_sizes(folded, label, s.max_classes))

    def part(i: int) -> Callable:
        def run() -> DataFrame:
            model = fit(folded.where(F.col(fold) != i), label, s)
            scored = model.add_probabilities(folded.where(F.col(fold) == i), out)
            return scored.withColumn(out, _aligned(out, model.classes, classes))

        return run

    held = [r[0] for r in folded.select(fold).distinct().collect()]  # fold numbers
    return _union(_together([part(i) for i in sorted(held)], s.threads))


@dataclass
class GridResult:
    best: float
    scores: DataFrame


def grid_search(
    folded: DataFrame, label: str, fit: Callable, grid: Sequence[float], s: Settings,
    fold: str = "fold",
) -> GridResult:
    """Mean macro F1 over the folds for every C; the first best one wins.

    Fits run side by side; all predictions are scored in one job.
    """

    def part(c: float, i: int) -> Callable:
        def run() -> DataFrame:
            own = Settings(**{**s.__dict__, "c": c})
            model = fit(folded.where(F.col(fold) != i), label, own)
            names = F.array(*[F.lit(x) for x in model.classes])
            return model.add_probabilities(folded.where(F.col(fold) == i), "_p").select(
                F.lit(c).alias("c"),
                F.lit(i).alias("fold"),
                F.col(label).alias("y_true"),
                argmax_label(F.col("_p"), names).alias("y_pred"),
            )

        return run

    held = sorted(r[0] for r in folded.select(fold).distinct().collect())  # fold numbers
    parts = _together([part(c, i) for c in grid for i in held], s.threads)
    per_fold = macro_f1(outcomes(_union(parts), by=["c", "fold"]), ["c", "fold"])
    means = {
        r["c"]: r["score"]
        for r in per_fold.groupBy("c").agg(F.avg("macro_f1").alias("score")).collect()
    }
    best = max(grid, key=lambda c: means[c])
    rows = [
        F.struct(
            F.lit(float(c)).alias("c"), F.lit(means[c]).alias("mean_macro_f1"),
            F.lit(c == best).alias("best"),
        )
        for c in grid
    ]
    scores = folded.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return GridResult(best, scores)


# --- two levels -----------------------------------------------------------------------------


def with_cascade_features(df: DataFrame, p1: str = "p1") -> DataFrame:
    """Append the level-1 probabilities to the feature vector.

    The names that the assembler gives every entry are dropped: they would go with every schema.
    """
    joined = VectorAssembler(inputCols=["_text", "_p1"], outputCol="features")
    staged = df.withColumnRenamed("features", "_text").withColumn("_p1", array_to_vector(p1))
    return joined.transform(staged).drop("_text", "_p1").withMetadata("features", {})


@dataclass
class Cascade:
    """Predictions of a two-level run, and the level-1 model behind them."""

    level1: Ensemble
    predictions: DataFrame
    first: Level | None = None
    second: Level | None = None


def level1(
    train: DataFrame, label: str, s: Settings, grid: Sequence[float] | None = None,
    folded: bool = True, group_column: str | None = None,
) -> Level:
    """The first level; ``folded`` or a grid adds the fits without each fold."""
    rows = bounded_rows(train, label, s)
    if not folded and grid is None:
        return fit_level(rows, label, s)
    rows = with_folds(rows, s.id_column, label, s.folds, group_column=group_column)
    return fit_level(rows, label, s, grid, fold="fold")


def _told(level: Level, test: DataFrame) -> DataFrame:
    return level.add_probabilities(test, "p1").withColumn(
        "pred1", argmax_label(F.col("p1"), level.class_names(F.lit(0))))


def fit_level1(
    train: DataFrame, test: DataFrame, label: str, s: Settings,
    grid: Sequence[float] | None = None,
) -> tuple[Level, DataFrame]:
    """The first level and the test rows with ``p1`` and ``pred1``."""
    level = level1(train, label, s, grid, folded=False)
    return level, _told(level, test)


def two_level(
    train: DataFrame,
    test: DataFrame,
    label1: str,
    label2: str,
    s: Settings = Settings(),
    score: str = "joint",
    grid1: Sequence[float] | None = None,
    grid2: Sequence[float] | None = None,
    group_column: str | None = None,
) -> Cascade:
    """Train level 1, then one level-2 ensemble per true level-1 class; route by prediction.

    Level 2 sees the text features plus the level-1 probabilities: out-of-fold ones in
    training, the model's own on test rows. All folds and cells of level 1 are one stack of fits,
    all groups of level 2 another. ``score`` is the confidence: ``joint`` multiplies both
    levels, ``level2`` is the level-2 maximum. ``group_column`` keeps groups of rows (a text and its
    paraphrases) in one fold. Output: the test ids and labels with ``pred1``, ``pred2``,
    ``conf``.
    """
    if score not in ("joint", "level2"):
        raise ValueError(f"unknown confidence: {score}")
    known = bounded_rows(train.where(F.col(label2).isNotNull()), label1, s, label2)
    folded = with_folds(known, s.id_column, label1, s.folds, group_column=group_column)
    first = fit_level(folded, label1, s, grid1, fold="fold")
    own = stage(with_cascade_features(first.out_of_fold("p1")).drop("fold"), "out_of_fold")
    routed = stage(with_cascade_features(_told(first, test)), "level1_test")
    fold2 = None
    if grid2 is not None:
        fold2, pair = "fold2", F.concat_ws("|", label1, label2)
        own = with_folds(
            own.withColumn("_pair", pair), s.id_column, "_pair", s.folds, out=fold2).drop("_pair")
    second = fit_level(own, label2, s, grid2, group=label1, fold=fold2)
    names = F.array(*[F.lit(g) for g in second.groups])
    g = (F.array_position(names, F.col("pred1")) - 1).cast("int")
    scored = stage(second.add_probabilities(routed, "p2", g), "level2_test")
    conf = (
        joint_confidence(F.col("p1"), F.col("p2"))
        if score == "joint"
        else confidence(F.col("p2"))
    )
    final = scored.withColumn("pred2", argmax_label(F.col("p2"), second.class_names(g))).withColumn(
        "conf", conf).drop("features")
    return Cascade(first.ensemble(), stage(final, "predictions"), first, second)
