"""Paraphrase augmentation around a caller-supplied text function."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from casebook.functions.text import MAX_PARAPHRASE_CHARS, has_non_ascii, within_length

Paraphrase = Callable[[str], str | None]


def neighbour_swap() -> Paraphrase:
    """An offline paraphrase: every two neighbouring words change places.

    The function is made here, so it travels to the workers by value and they need no copy of
    this package.
    """

    def swap(text: str) -> str:
        parts = text.split()
        for i in range(0, len(parts) - 1, 2):
            parts[i], parts[i + 1] = parts[i + 1], parts[i]
        return " ".join(parts)

    return swap


def minority_rows(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """The training rows to paraphrase."""
    return df.where(F.col(column).isin(list(labels)))


def paraphrase_rows(
    df: DataFrame,
    text_column: str,
    paraphrase: Paraphrase,
    id_column: str = "doc_id",
    limit: int = MAX_PARAPHRASE_CHARS,
    tasks: int | None = None,
) -> DataFrame:
    """Copies of the rows with paraphrased text, plus ``source_doc_id`` and ``is_augmented``.

    Texts above ``limit`` are skipped. A paraphrase that fails, is empty or holds non-ASCII
    characters drops its row. ``paraphrase`` may be slow (a web service), so the rows are spread
    over ``tasks`` tasks (default: all slots). A copy gets a new id: the complement of the
    source id, which is negative and thus free.
    """
    made = _attempted(df, text_column, paraphrase, limit, tasks)
    return made.where(F.col("_outcome") == "kept").drop("_outcome").withColumns(
        {
            "source_doc_id": F.col(id_column),
            id_column: F.bitwise_not(F.col(id_column)),
            "is_augmented": F.lit(True),
        }
    )


def _attempted(
    df: DataFrame, text_column: str, paraphrase: Paraphrase, limit: int, tasks: int | None
) -> DataFrame:
    """The rows with their paraphrase and its ``_outcome``."""

    @F.pandas_udf("string")
    def attempts(texts: pd.Series) -> pd.Series:
        def attempt(text: str | None) -> str | None:
            try:
                return None if text is None else paraphrase(text)
            except Exception:
                return None

        return texts.map(attempt)

    short = F.coalesce(within_length(F.col(text_column), limit), F.lit(False))
    slots = tasks or df.sparkSession.sparkContext.defaultParallelism
    made = df.repartition(slots).withColumns({
        # Not to be run twice for the outcome and the text.
        "_short": short, "_made": attempts.asNondeterministic()(F.when(short, F.col(text_column))),
    })
    outcome = (
        F.when(~F.col("_short"), "skipped")
        .when(F.col("_made").isNull() | (F.col("_made") == ""), "failed")
        .when(has_non_ascii(F.col("_made")), "rejected")
        .otherwise("kept")
    )
    return made.withColumn("_outcome", outcome).withColumn(text_column, F.col("_made")).drop(
        "_short", "_made")


def paraphrase_counts(
    df: DataFrame, text_column: str, paraphrase: Paraphrase, limit: int = MAX_PARAPHRASE_CHARS,
    tasks: int | None = None,
) -> DataFrame:
    """One row: texts skipped as too long, attempts, failed and non-ASCII ones, copies kept."""
    made = _attempted(df.select(text_column), text_column, paraphrase, limit, tasks)
    outcome = F.col("_outcome")
    return made.agg(
        F.count_if(outcome == "skipped").alias("n_skipped"),
        F.count_if(outcome != "skipped").alias("n_attempts"),
        F.count_if(outcome == "failed").alias("n_failed"),
        F.count_if(outcome == "rejected").alias("n_rejected"),
        F.count_if(outcome == "kept").alias("n_kept"),
    )


def append_augmented(
    train: DataFrame, augmented: DataFrame, id_column: str = "doc_id"
) -> DataFrame:
    """Training rows plus their copies; with no copies the training rows stay as they are."""
    original = train.withColumns(
        {"source_doc_id": F.col(id_column), "is_augmented": F.lit(False)}
    )
    return original.unionByName(augmented)
