"""Flow 3: train both levels, evaluate, and decide what people review."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from casebook.operators import evaluate
from casebook.operators.classify import Cascade, Settings, fit_level1, two_level
from casebook.operators.labels import regroup
from casebook.operators.taxonomy import BROAD_GROUPS
from casebook.plans.prepare import Prepared


def broad_cascade(p: Prepared, s: Settings = Settings()) -> Cascade:
    """Two broad groups first, sub-issue groups second, joint confidence.

    Training rows without a broad group have no level-1 label and are left out, see
    :func:`unlabelled_rows`; every test row is predicted.
    """
    return two_level(p.train, p.test, "broad_group", "sub_issue_group", s, score="joint")


def unlabelled_rows(train: DataFrame, test: DataFrame, level1: str = "broad_group") -> DataFrame:
    """``(part, n_rows, n_left_out)``: rows without a level-1 label, which no fit uses."""
    both = train.select(F.lit("train").alias("part"), level1).unionByName(
        test.select(F.lit("test").alias("part"), level1))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(level1).isNull()).alias("n_left_out"))


def issue_cascade(
    p: Prepared, s: Settings = Settings(),
    grid1: Sequence[float] | None = None, grid2: Sequence[float] | None = None,
) -> Cascade:
    """Issue groups first, sub-issue groups second, level-2 confidence, optional grids."""
    return two_level(
        p.train, p.test, "issue_group", "sub_issue_group", s,
        score="level2", grid1=grid1, grid2=grid2,
    )


def alternative_level1(
    p: Prepared, s: Settings = Settings(), grid: Sequence[float] | None = None
) -> DataFrame:
    """Test rows with ``y_true`` and ``pred1`` of the two-way grouping of the issue groups."""
    train, test = (
        regroup(df, "issue_group", BROAD_GROUPS, "issue_alternative") for df in (p.train, p.test)
    )
    _, scored = fit_level1(
        train.where("issue_alternative is not null"),
        test.where("issue_alternative is not null"),
        "issue_alternative", s, grid,
    )
    return scored.select("doc_id", F.col("issue_alternative").alias("y_true"), "pred1", "p1")


@dataclass
class Report:
    """All evaluation tables of one run."""

    level1_report: DataFrame
    level1_confusion: DataFrame
    level1_pairs: DataFrame
    level2_report: DataFrame
    auto_report: DataFrame
    auto_confusion: DataFrame
    rejection: DataFrame
    review_labels: DataFrame
    buckets: DataFrame
    sweep: DataFrame


def report(run: Cascade, level1: str, level2: str, classes2: Sequence[str]) -> Report:
    """Evaluation of a two-level run."""
    rows = run.predictions
    first = evaluate.outcomes(rows, level1, "pred1")
    matrix = evaluate.confusion(first, run.level1.classes)
    return Report(
        evaluate.class_report(first),
        matrix,
        evaluate.confusion_pairs(matrix),
        evaluate.class_report(evaluate.outcomes(rows, level2, "pred2")),
        evaluate.final_report(rows, true=level2, pred="pred2"),
        evaluate.auto_confusion(rows, classes2, true=level2, pred="pred2"),
        evaluate.rejection(rows, true=level2, pred="pred2"),
        evaluate.review_labels(rows, true=level2),
        evaluate.confidence_buckets(rows),
        evaluate.threshold_sweep(rows, true=level2, pred="pred2"),
    )


def run_summary(
    run: Cascade, level2: str, original: DataFrame, alternative: DataFrame
) -> DataFrame:
    """``(metric, value)``: macro F1 of both level-1 groupings and of level 2, review share.

    ``original`` and ``alternative`` hold ``y_true`` and ``pred1`` of the two level-1 runs.
    """

    def level1(df: DataFrame) -> DataFrame:
        return evaluate.macro_f1(evaluate.outcomes(df, "y_true", "pred1"))

    rejected = evaluate.rejection(run.predictions, true=level2, pred="pred2")
    parts = [
        ("level1_macro_f1", level1(original), "macro_f1"),
        ("level1_macro_f1_alternative", level1(alternative), "macro_f1"),
        ("level2_macro_f1_all", rejected, "f1_all"),
        ("level2_macro_f1_auto", rejected, "f1_auto"),
        ("review_share", rejected, "review_share"),
    ]
    lines = [
        df.select(F.lit(name).alias("metric"), F.col(column).alias("value"))
        for name, df, column in parts
    ]
    return reduce(DataFrame.unionByName, lines)
