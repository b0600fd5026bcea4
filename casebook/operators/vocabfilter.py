"""Row filter by vocabulary size, with its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.operators.distribution import quantile
from casebook.sources.staging import stage


def unique_tokens(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens))


def keep_by_vocabulary(
    df: DataFrame, tokens: str, smallest: int = 5, largest: int = 500
) -> DataFrame:
    """Rows with ``smallest`` to ``largest`` unique tokens, both included."""
    return df.where(unique_tokens(F.col(tokens)).between(smallest, largest))


def vocabulary_stats(
    df: DataFrame, tokens: str, smallest: int = 5, largest: int = 500
) -> DataFrame:
    """One row on what :func:`keep_by_vocabulary` keeps. Halves round to even."""
    sizes = stage(
        df.select(unique_tokens(F.col(tokens)).alias("uniq"), F.size(tokens).alias("total")),
        "token_sizes",
    )
    kept = F.col("uniq").between(smallest, largest)
    middle = F.lit(quantile(sizes.where(kept), "uniq", 0.5)).cast("double")
    one_row = sizes.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(F.col("uniq") < smallest).alias("removed_low"),
        F.count_if(F.col("uniq") > largest).alias("removed_high"),
        F.count_if(kept).alias("final"),
        F.avg(F.when(kept, F.col("uniq"))).alias("mean_unique"),
        F.avg(F.when(kept, F.col("total"))).alias("mean_tokens"),
    )
    share = F.try_divide(100.0 * F.col("final"), F.col("original"))
    return one_row.select(
        "original", "removed_low", "removed_high", "final",
        F.bround("mean_unique", 1).alias("mean_unique"),
        F.bround(middle, 1).alias("median_unique"),
        F.bround("mean_tokens", 1).alias("mean_tokens"),
        F.bround(share, 2).alias("pct_kept"),
    )
