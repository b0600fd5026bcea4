"""Exact histogram of encoded lengths, with suffix sums that answer for every context limit.

Null and empty texts have length 0. Repeated rows count as often as they occur; an empty table
gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casebook.llm.encoder import packed_ids, release, tokenizer_path
from casebook.llm.memory import tidy
from casebook.sources.staging import stage

BLOCK = 4096


def _lengths(batches: Iterator[pa.RecordBatch], path: str):
    counts: Counter[int] = Counter()
    for batch in batches:
        counts.update(len(packed_ids(t.as_py(), path)) // 4 for t in batch.column(0))
    if counts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
            ["n_tokens", "n_docs"],
        )


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(n_tokens, n_docs)``: one row per task and length is shuffled."""
    path = tokenizer or tokenizer_path()
    partial = docs.select("text").mapInArrow(
        tidy(lambda batches: _lengths(batches, path), release), "n_tokens long, n_docs long"
    )
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each occurring length: documents and tokens from it upwards, and below it.

    ``docs_from`` and ``tokens_from`` count lengths >= n_tokens; ``truncated_tokens`` is the
    total when every document is cut at n_tokens; ``docs_upto`` is the rank that quantiles use.
    Sums run within blocks of lengths; block totals carry the rest. The histogram is staged, so
    the texts are encoded once.
    """
    histogram = stage(histogram, "histogram")
    rows = histogram.withColumns({
        "_block": F.floor(F.col("n_tokens") / BLOCK),
        "_tokens": F.col("n_tokens") * F.col("n_docs"),
    })
    blocks = rows.groupBy("_block").agg(
        F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum")
    )
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    carried = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(everything).alias("_all_docs"),
        F.sum("_sum").over(everything).alias("_all_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    summed = rows.join(carried, "_block").withColumns({
        "docs_from": F.sum("n_docs").over(inside) + F.col("_docs_after"),
        "tokens_from": F.sum("_tokens").over(inside) + F.col("_tokens_after"),
    })
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("_all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (
            F.col("_all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
        ).alias("truncated_tokens"),
        F.col("_all_docs").alias("all_docs"),
        F.col("_all_tokens").alias("all_tokens"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(limit, docs_over, tokens_kept)`` for any context limits, occurring lengths or not."""
    limits = sorted(set(limits))
    totals = histogram.agg(*[
        F.coalesce(F.sum(expression), F.lit(0)).alias(f"{name}{limit}")
        for limit in limits
        for name, expression in (
            ("over", F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)),
            ("kept", F.least("n_tokens", F.lit(limit)) * F.col("n_docs")),
        )
    ])
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(limit).cast("long").alias("limit"),
            F.col(f"over{limit}").alias("docs_over"),
            F.col(f"kept{limit}").alias("tokens_kept"),
        )
        for limit in limits
    ])).alias("row")
    return totals.select(rows).select("row.*")


def quantile(summed: DataFrame, probability: float) -> DataFrame:
    """The smallest length that covers the share of documents; no row without documents."""
    wanted = summed.where(F.col("docs_upto") >= F.col("all_docs") * F.lit(probability))
    return wanted.agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens is not null")
