"""Confusion, macro F1, reports, thresholds and review triage.

Every measure starts from :func:`outcomes`, one small staged count table that a single pass
over the predictions gives (counted in the map tasks first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from casebook.sources.staging import stage

# Thresholds of the sweep, the chosen one, and the confidence buckets.
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]
REVIEW_THRESHOLD = 0.45
BUCKETS = [
    ("<0.40", 0.0, 0.40), ("0.40-0.55", 0.40, 0.55), ("0.55-0.70", 0.55, 0.70),
    ("0.70-0.85", 0.70, 0.85), (">0.85", 0.85, 1.01),
]


def outcomes(
    df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, t, p, n)``: how often true label ``t`` was predicted as ``p``.

    Rows without a true label are no part of it.
    """
    counts = df.where(F.col(true).isNotNull()).groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return stage(counts, "outcomes")


def confusion(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(t, p, n)`` for all pairs of the class list, zeros included; other labels are left out."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = (
        counts.sparkSession.range(1)
        .select(F.explode(names).alias("t"))
        .select("t", F.explode(names).alias("p"))
    )
    return grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_pairs(matrix: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest shares of a true class predicted as another one."""
    row_total = F.sum("n").over(Window.partitionBy("t"))
    return (
        matrix.withColumn("total", row_total)
        .where((F.col("t") != F.col("p")) & (F.col("n") > 0))
        .select("t", "p", "n", (F.col("n") / F.col("total")).alias("rate"))
        .orderBy(F.desc("rate"), "t", "p")
        .limit(k)
    )


def label_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, precision, recall, f1, support)`` over true and predicted labels.

    A measure whose denominator is 0 is 0.
    """
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), n).otherwise(none)

    def role(label: str, tp, actual, predicted):
        return F.struct(
            F.col(label).alias("label"), tp.alias("tp"), actual.alias("actual"),
            predicted.alias("predicted"),
        )

    roles = F.array(role("t", hit, n, none), role("p", none, none, n))
    sums = (
        counts.select(*by, F.inline(roles))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(1.0 * a, b), F.lit(0.0))

    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    return sums.select(
        *by, "label",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, actual).alias("recall"),
        ratio(2 * tp, actual + predicted).alias("f1"),
        actual.alias("support"),
        "tp",
    )


def macro_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, macro_f1)``: the plain mean of F1 over true and predicted labels."""
    return label_scores(counts, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def class_report(counts: DataFrame) -> DataFrame:
    """Scores per label plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    scores = label_scores(counts)
    measures = ["precision", "recall", "f1"]
    weight = F.col("support")
    totals = scores.agg(
        (F.sum("tp") / F.sum(weight)).alias("accuracy"),
        F.sum(weight).alias("support"),
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        *[(F.sum(F.col(m) * weight) / F.sum(weight)).alias(f"{m}_weighted") for m in measures],
    )

    def line(name: str, columns: Sequence[str]):
        values = [F.col(c).alias(m) for c, m in zip(columns, measures)]
        return F.struct(F.lit(name).alias("label"), *values, F.col("support"))

    extra = F.array(
        line("accuracy", ["accuracy"] * 3),
        line("macro avg", [f"{m}_macro" for m in measures]),
        line("weighted avg", [f"{m}_weighted" for m in measures]),
    )
    return scores.drop("tp").unionByName(totals.select(F.inline(extra)))


def rejection(
    df: DataFrame,
    confidence: str = "conf",
    threshold: float = REVIEW_THRESHOLD,
    true: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """One row: rows, automatic and review counts and shares, macro F1 on automatic and on all."""
    flagged = df.withColumn("auto", F.col(confidence) >= threshold)
    counts = outcomes(flagged, true, pred, ["auto"])
    scopes = F.when(F.col("auto"), F.array(F.lit("auto"), F.lit("all"))).otherwise(
        F.array(F.lit("all"))
    )
    scoped = (
        counts.select(F.explode(scopes).alias("scope"), "t", "p", "n")
        .groupBy("scope", "t", "p")
        .agg(F.sum("n").alias("n"))
    )
    sizes = scoped.groupBy("scope").agg(F.sum("n").alias("n"))
    both = sizes.join(macro_f1(scoped, ["scope"]), "scope")

    def of(scope: str, column: str):
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    n_all, n_auto = F.coalesce(of("all", "n"), F.lit(0)), F.coalesce(of("auto", "n"), F.lit(0))
    return both.agg(
        n_all.alias("n_total"),
        n_auto.alias("n_auto"),
        (n_all - n_auto).alias("n_review"),
        F.try_divide(1.0 * n_auto, n_all).alias("auto_share"),
        F.try_divide(1.0 * (n_all - n_auto), n_all).alias("review_share"),
        F.coalesce(of("auto", "macro_f1"), F.lit(0.0)).alias("f1_auto"),
        F.coalesce(of("all", "macro_f1"), F.lit(0.0)).alias("f1_all"),
    )


def review_labels(
    df: DataFrame,
    confidence: str = "conf",
    threshold: float = REVIEW_THRESHOLD,
    true: str = "y_true",
) -> DataFrame:
    """True labels of the review pile, most frequent first."""
    return (
        df.where((F.col(confidence) < threshold) & F.col(true).isNotNull())
        .groupBy(F.col(true).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def confidence_buckets(df: DataFrame, confidence: str = "conf") -> DataFrame:
    """``(place, bucket, n)`` in order, empty buckets kept; buckets are closed on the left."""
    c = F.col(confidence)
    sums = df.agg(
        *[F.count_if((c >= lo) & (c < hi)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(BUCKETS)]
    )
    rows = [
        F.struct(F.lit(i).cast("long").alias("place"), F.lit(name).alias("bucket"),
                 F.col(f"b{i}").alias("n"))
        for i, (name, _, _) in enumerate(BUCKETS)
    ]
    return sums.select(F.inline(F.array(*rows)))


def threshold_sweep(
    df: DataFrame,
    confidence: str = "conf",
    thresholds: Sequence[float] = THRESHOLDS,
    true: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """``(threshold, n_auto, review_pct, auto_f1)`` for every threshold, from one pass.

    Rows are counted by how many thresholds they reach; the few counts then spread to these
    thresholds. Nothing automatic means F1 0.
    """
    ordered = sorted(thresholds)
    reached = sum(
        (F.when(F.col(confidence) >= t, 1).otherwise(0) for t in ordered), F.lit(0)
    )
    counts = outcomes(df.withColumn("reached", reached), true, pred, ["reached"])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    passing = (
        counts.where("reached > 0")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("reached"))))
        .groupBy("step", "t", "p")
        .agg(F.sum("n").alias("n"))
    )
    sizes = passing.groupBy("step").agg(F.sum("n").alias("n_auto"))
    frame = df.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold"))
                    for i, t in enumerate(ordered, start=1)
                ]
            )
        )
    )
    n_auto = F.coalesce("n_auto", F.lit(0))
    return (
        frame.join(sizes, "step", "left")
        .join(macro_f1(passing, ["step"]), "step", "left")
        .select(
            "threshold",
            n_auto.alias("n_auto"),
            F.try_divide(100.0 * (total - n_auto), total).alias("review_pct"),
            F.coalesce("macro_f1", F.lit(0.0)).alias("auto_f1"),
        )
        .orderBy("threshold")
    )


def final_report(
    df: DataFrame,
    confidence: str = "conf",
    threshold: float = REVIEW_THRESHOLD,
    true: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """The class report of the automatic rows."""
    return class_report(outcomes(df.where(F.col(confidence) >= threshold), true, pred))


def auto_confusion(
    df: DataFrame,
    classes: Sequence[str],
    confidence: str = "conf",
    threshold: float = REVIEW_THRESHOLD,
    true: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """The confusion matrix of the automatic rows."""
    return confusion(outcomes(df.where(F.col(confidence) >= threshold), true, pred), classes)
