"""Frequencies, top-k and time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from casebook.sources.staging import stage


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact number of distinct non-NULL values of each column."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)``, most frequent first, ties by value; NULL is left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return frequencies(df, column).limit(k)


def monthly_volume(df: DataFrame, date_column: str) -> DataFrame:
    """Rows per month with a month-end label; empty months give 0, the last month is dropped.

    Rows are counted per month first. Everything after that works on one row per month: each
    month opens the gap up to the next one, and the last month, which has no next, opens none.
    """
    per_month = (
        df.where(F.col(date_column).isNotNull())
        .groupBy(F.trunc(date_column, "month").alias("start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    following = F.lead("start").over(Window.orderBy("start"))
    gaps = per_month.withColumn("next", following).withColumn(
        "month", F.explode(F.expr("sequence(start, add_months(next, -1), interval 1 month)"))
    )
    return gaps.select(
        F.last_day("month").alias("month_end"),
        F.when(F.col("month") == F.col("start"), F.col("n")).otherwise(F.lit(0)).alias("n"),
    ).orderBy("month_end")


def yearly_volume(df: DataFrame, date_column: str) -> DataFrame:
    return (
        df.where(F.col(date_column).isNotNull())
        .groupBy(F.year(date_column).alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("year")
    )


def monthly_rate(
    df: DataFrame, entity: str, date_column: str, flag: str, value: str
) -> DataFrame:
    """Per entity and month, ``100 * #(flag = value) / #rows``; observed pairs only.

    NULL flags count in the denominator and never in the numerator; rows without an entity or a
    date belong to no pair.
    """
    known = df.where(F.col(entity).isNotNull() & F.col(date_column).isNotNull())
    return known.groupBy(entity, F.last_day(date_column).alias("month_end")).agg(
        (100.0 * F.count_if(F.col(flag) == value) / F.count(F.lit(1))).alias("rate_pct")
    )


def child_frequencies(df: DataFrame, parent: str, child: str) -> DataFrame:
    """``(parent, parent_n, child, n, share)`` for every parent; one pass over the rows."""
    pairs = df.where(F.col(parent).isNotNull()).groupBy(parent, child).agg(
        F.count(F.lit(1)).alias("n")
    )
    of_parent = F.sum("n").over(Window.partitionBy(parent))
    return (
        pairs.withColumn("parent_n", of_parent)
        .where(F.col(child).isNotNull())
        .select(parent, "parent_n", child, "n", (F.col("n") / F.col("parent_n")).alias("share"))
    )


def top_parent_children(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Child frequencies within the most frequent parent (ties by name)."""
    pairs = stage(
        df.where(F.col(parent).isNotNull()).groupBy(parent, child).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "pair_counts",
    )
    top = (
        pairs.groupBy(parent)
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), parent)
        .limit(1)
        .select(parent)
    )
    return (
        pairs.where(F.col(child).isNotNull())
        .join(F.broadcast(top), parent, "left_semi")  # one row
        .select(F.col(child).alias("value"), "n")
        .orderBy(F.desc("n"), "value")
    )


def tag_periods(
    df: DataFrame, date_column: str, periods: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Add ``period``: the name of the half-open interval ``[start, end)`` that holds the date.

    ``periods`` is a short list in code, so it becomes a CASE expression: no join. Where
    intervals overlap, the first one listed wins.
    """
    tag = F.lit(None).cast("string")
    for name, start, end in reversed(list(periods)):
        inside = (F.col(date_column) >= F.to_date(F.lit(start))) & (
            F.col(date_column) < F.to_date(F.lit(end))
        )
        tag = F.when(inside, F.lit(name)).otherwise(tag)
    return df.withColumn("period", tag)
