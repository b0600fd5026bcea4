"""Summary statistics, exact quantiles, histograms, densities and shares.

The value-based ones write the column once, as it is, and read it as often as they need: no value
is shuffled, only counts per range or bin and task. NULL and NaN are no values. Its three scalars
(smallest, largest, number) and the ends of the ranges that hold a wanted rank go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casebook.sources.staging import stage


@dataclass(frozen=True)
class Values:
    """Staged ``table (v)`` with its range and the number of values in it."""

    table: DataFrame
    lo: float | None
    hi: float | None
    total: int

    @property
    def width(self) -> float:
        return self.hi - self.lo if self.total else 0.0


def values_of(df: DataFrame, column: str) -> Values:
    """The column's values as doubles, NULL and NaN left out."""
    v = F.col(column).cast("double")
    table = stage(df.select(v.alias("v")).where("v is not null and not isnan(v)"), "values")
    span = table.agg(F.min("v"), F.max("v"), F.count("v")).first()
    return Values(table, span[0], span[1], span[2])


def _bin(lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``v``; the largest value falls into the last one."""
    if not hi > lo:
        return F.lit(0).cast("long")
    return F.least(F.floor((F.col("v") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("long")


#: Bits of a value's key that each pass tells: as many passes at most, whatever the values.
DIGITS = (16, 12, 12, 12, 12)
_SIGN = np.uint64(1 << 63)


def _keys(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles, minus infinity first; -0 and 0 are one."""
    bits = (v + 0.0).view(np.uint64)
    return np.where(bits >= _SIGN, ~bits, bits | _SIGN)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(opened: list[int], shift: int, width: int):
    """How many values have each digit behind the opened prefixes, and the least and greatest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = np.array(opened, np.uint64)
        for batch in batches:
            keys = np.sort(_keys(batch.column(0).to_numpy()))
            leading = keys >> np.uint64(shift + width) if shift + width < 64 else keys & np.uint64(0)
            firsts = np.searchsorted(leading, prefixes, "left")
            ends = np.searchsorted(leading, prefixes, "right")
            for i, (a, b) in enumerate(zip(firsts, ends)):
                own = keys[a:b]
                digits, at, n = np.unique(
                    (own >> np.uint64(shift)) & np.uint64((1 << width) - 1),
                    return_index=True, return_counts=True)
                if len(n):
                    low, high = own[at] ^ _SIGN, own[at + n - 1] ^ _SIGN  # in signed order
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), i, np.int32)), pa.array(digits.astype(np.int32)),
                         pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)),
                         pa.array(high.view(np.int64))], ["i", "digit", "n", "low", "high"])

    return run


def _ranked(c: Values, ranks: set[int], digits: Sequence[int] = DIGITS) -> dict[int, float]:
    """The values at the given ranks, by radix selection.

    Every pass counts one digit of the values' keys behind the prefixes that hold a wanted rank; a
    prefix whose values are all equal is done. Nothing but counts of digits is shuffled, and the
    driver sees ``2 ** digit`` rows at most for each prefix.
    """
    found: dict[int, float] = {}
    places = {r: (0, 0) for r in ranks}  # by rank: prefix, values below it
    shift = 64
    for width in digits:
        if not places:
            break
        shift -= width
        opened = sorted({prefix for prefix, _ in places.values()})
        counts = c.table.select("v").mapInArrow(
            _digit_counts(opened, shift, width), "i int, digit int, n long, low long, high long",
        ).groupBy("i", "digit").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        ).orderBy("i", "digit").collect()
        by_prefix: dict[int, list] = {p: [] for p in opened}
        for row in counts:
            by_prefix[opened[row["i"]]].append(row)
        for rank, (prefix, below) in list(places.items()):
            for part in by_prefix[prefix]:
                if rank < below + part["n"]:
                    break
                below += part["n"]
            if part["low"] == part["high"]:
                found[rank] = _double((part["low"] % (1 << 64)) ^ (1 << 63))
                del places[rank]
            else:
                places[rank] = (prefix << width) | part["digit"], below
    return found


def _between(low: float, high: float, share: float) -> float:
    """Linear interpolation that neither overflows nor leaves equal or infinite ends."""
    if low == high or share == 0:
        return low
    if math.isinf(high - low):
        return low * (1 - share) + high * share
    return low + (high - low) * share


def _quantiles(
    c: Values, probabilities: Sequence[float], digits: Sequence[int] = DIGITS
) -> dict[float, float]:
    if not c.total:
        return {}
    places = {float(p): p * (c.total - 1) for p in probabilities}
    ranks = {f(x) for x in places.values() for f in (math.floor, math.ceil)}
    at = _ranked(c, ranks, digits)
    return {
        p: _between(at[math.floor(x)], at[math.ceil(x)], x - math.floor(x))
        for p, x in places.items()}


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], digits: Sequence[int] = DIGITS
) -> DataFrame:
    """``(p, value)`` with linear interpolation, exact and without ordering any values.

    See :func:`_ranked`; ``digits`` are bits that add up to 64. No values, no quantiles; between
    the two infinities lies NaN.
    """
    found = _quantiles(values_of(df, column), probabilities, digits)
    return df.sparkSession.createDataFrame(list(found.items()), "p double, value double")


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    """One exact quantile; None without values."""
    return _quantiles(values_of(df, column), [p]).get(float(p))


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample std, min, quartiles, max."""
    c = values_of(df, column)
    at = _quantiles(c, [0.25, 0.5, 0.75])
    v = F.col("v")
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    return c.table.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        *[F.lit(at.get(p)).cast("double").alias(name) for p, name in names.items()],
        F.max(v).alias("max"),
    )


def quantile_gate(df: DataFrame, column: str, p: float) -> DataFrame:
    """Rows whose value is at least the column's own ``p`` quantile."""
    return df.where(F.col(column) >= F.lit(quantile(df, column, p)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, lo, hi, n)``: equal widths over ``[min, max]``, last bin closed, empty bins kept."""
    c = values_of(df, column)
    filled = c.table.groupBy(_bin(c.lo or 0.0, c.hi or 0.0, bins).alias("bin")).agg(
        F.count("v").alias("n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin")

    def edge(i: Column) -> Column:
        return F.lit(c.lo).cast("double") + i * F.lit(c.width) / bins

    return (
        frame.join(filled, "bin", "left")
        .select(
            F.col("bin"),
            edge(F.col("bin")).alias("lo"),
            edge(F.col("bin") + 1).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


#: Cells of the binned column to one bandwidth.
CELLS_PER_BANDWIDTH = 4096


def _kernel_sums(x: np.ndarray, lo: float, step: float, h: float):
    """What the cells of a task add to the kernel sums at the points ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(len(x))
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            n, part = batch.column("n").to_numpy(), batch.column("part").to_numpy()
            for at in range(0, len(cell), 4096):
                some = slice(at, at + 4096)
                for edge, weight in ((0, (n - part)[some]), (1, part[some])):
                    v = lo + (cell[some] + edge) * step
                    mass += np.exp(-0.5 * ((x[:, None] - v[None]) / h) ** 2) @ weight
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(x))), pa.array(mass)], ["point", "mass"])

    return run


def kernel_density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """``(point, x, density)``: Gaussian kernels, Scott bandwidth, grid over ``[min, max]``.

    Values are counted in cells of a ``CELLS_PER_BANDWIDTH``-th of the bandwidth ``h``, each shared
    between the two ends of its cell by distance, and the kernel is applied to the cells. That is
    linear interpolation of the kernel, so a density is off by less than ``3e-9 / h`` (its second
    derivative is ``1 / (sqrt(2 pi) h^3)`` at most). Cells grow with the power 1/5 of the rows.
    A column without spread or with an infinite value has no density and gives no rows.
    """
    c = values_of(df, column)
    spread = c.table.agg(F.stddev_samp("v")).first()[0] if c.width > 0 else None
    spread = spread if spread and math.isfinite(c.width) and math.isfinite(spread) else 0.0
    h = spread * max(c.total, 1) ** -0.2 or 1.0
    lo, step = c.lo or 0.0, h / CELLS_PER_BANDWIDTH
    x = lo + np.arange(points) * (c.width if spread else 0.0) / (points - 1)
    place = (F.col("v") - lo) / step
    cells = c.table.where(F.lit(spread > 0)).groupBy(F.floor(place).alias("cell")).agg(
        F.count("v").cast("double").alias("n"), F.sum(place - F.floor(place)).alias("part"))
    sums = cells.mapInArrow(_kernel_sums(x, lo, step, h), "point long, mass double")
    at = F.lit(lo) + F.col("point") * F.lit(c.width if spread else 0.0) / (points - 1)
    return (
        sums.groupBy("point").agg(F.sum("mass").alias("mass"))
        .where(F.lit(spread > 0))
        .select(
            "point", at.alias("x"),
            (F.col("mass") / (c.total * h * F.sqrt(2 * F.pi()))).alias("density"),
        )
        .orderBy("point")
    )


def allocation(df: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """``(bucket, n, pct)`` for the automatic and the review share; both rows always exist."""
    totals = df.agg(
        F.count_if(F.col(confidence) >= threshold).alias("auto"), F.count(F.lit(1)).alias("total")
    )
    rows = F.array(
        F.struct(F.lit("auto").alias("bucket"), F.col("auto").alias("n"), F.col("total")),
        F.struct(
            F.lit("review").alias("bucket"), (F.col("total") - F.col("auto")).alias("n"),
            F.col("total"),
        ),
    )
    return totals.select(F.inline(rows)).select(
        "bucket", "n", F.try_divide(100.0 * F.col("n"), F.col("total")).alias("pct")
    )


def class_floor(df: DataFrame, label: str) -> DataFrame:
    """The size of the smallest class."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("smallest"))
