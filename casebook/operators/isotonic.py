"""Isotonic fits of many score columns at once, pooled where the rows lie.

Pooling adjacent violators may start anywhere: the blocks of two neighbouring score ranges, pooled
again, are the blocks of both. So rows are counted by score, dealt in ranges of (fit, score) and pooled
in every task to blocks; the blocks of neighbouring ranges are pooled again in ever fewer ranges,
and at last by fit. No task meets the rows of a fit as a whole, and the driver none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebook.sources.staging import stage

#: Neighbouring ranges that are pooled together in a round.
FAN_IN = 8
_STEP = "fit int, low double, high double, weight double, total double"


def pooled(low, high, weight, total) -> list[np.ndarray]:
    """Blocks in order of score, with means that rise strictly; equal neighbours join."""
    stack: list[list[float]] = []
    for a, b, w, t in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        block = [a, b, w, t]
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            last = stack.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        stack.append(block)
    return [np.array(c, float) for c in zip(*stack)] if stack else [np.zeros(0)] * 4


def pooled_scores(score: np.ndarray, hit: np.ndarray) -> list[np.ndarray]:
    """Blocks of rows at hand; rows of one score count as one."""
    low, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place, minlength=len(low)).astype(float)
    return pooled(low, low, weight, np.bincount(place, hit, len(low)))


def curve(low, high, weight, total) -> tuple[np.ndarray, np.ndarray]:
    """Scores and values of rising blocks for :func:`numpy.interp`, two for a block."""
    return np.column_stack([low, high]).ravel(), np.repeat(total / weight, 2)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of every fit of a sorted range; the open fit's blocks are carried to the next batch."""
    names = ["low", "high", "weight", "total"]
    fit, held = None, [np.zeros(0)] * 4

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held[0]), fit, np.int32)), *map(pa.array, held)], ["fit", *names])

    for batch in batches:
        fits = batch.column("fit").to_numpy()
        cells = [batch.column(n).to_numpy() for n in names]
        edges = np.flatnonzero(np.diff(fits, prepend=fits[:1] - 1))
        for a, b in zip(edges, np.append(edges[1:], len(fits))):
            if fits[a] != fit:
                if fit is not None:
                    yield out()
                fit, held = int(fits[a]), [np.zeros(0)] * 4
            held = pooled(*[np.concatenate([h, c[a:b]]) for h, c in zip(held, cells)])
    if fit is not None:
        yield out()


def fit_isotonic(rows: DataFrame) -> DataFrame:
    """``(fit, low, high, weight, total)``: rising blocks of ``(fit, score, hit, weight)`` rows, staged.

    ``hit`` is the target. Rows of one score count as one with their mean. The value of a block is
    ``total / weight``, from its least to its greatest score.
    """
    spark = rows.sparkSession
    blocks = rows.groupBy("fit", F.col("score").alias("low")).agg(
        F.max("score").alias("high"), F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * F.col("hit")).alias("total"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while ranges > FAN_IN:
        dealt = blocks.repartitionByRange(ranges, "fit", "low").sortWithinPartitions("fit", "low")
        blocks = stage(_pooled_frame(dealt), "pooled")
        ranges = -(-ranges // FAN_IN)
    return stage(_pooled_frame(blocks.repartition("fit").sortWithinPartitions("fit", "low")), "pooled")


def _pooled_frame(dealt: DataFrame) -> DataFrame:
    return dealt.select("fit", "low", "high", "weight", "total").mapInArrow(_pool, _STEP)


def curves(blocks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Scores and values of every fit on the driver, see :func:`curve`.

    With hits of 0 or 1 blocks have different fractions as values, so their number grows with
    the power 2/3 of the rows at most.
    """
    table = blocks.toArrow()
    names = ("fit", "low", "high", "weight", "total")
    cells = [table[c].to_numpy() for c in names]
    order = np.lexsort((cells[1], cells[0]))
    fits, *cells = [c[order] for c in cells]
    edges = np.flatnonzero(np.diff(fits, prepend=fits[:1] - 1))
    return {
        int(fits[a]): curve(*[c[a:b] for c in cells])
        for a, b in zip(edges, np.append(edges[1:], len(fits)))}
