"""Contingency tables, chi-square and bias-corrected Cramér's V."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window, functions as F


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, n)`` for the observed pairs; rows with a NULL on either side are left out."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).alias("x"), F.col(y).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col1, col2, x, y, n)`` for every unordered pair of columns, in one job.

    Rows are counted per combination of all columns first; the combinations then spread into
    their pairs. The shuffles carry counts only, and a hot combination is one row per task.
    """
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("weight"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("col1"), F.lit(b).alias("col2"),
                F.col(a).alias("x"), F.col(b).alias("y"),
            )
            for a, b in combinations_with_replacement(columns, 2)
        ]
    )
    return (
        combos.select(F.inline(pairs), "weight")
        .where("x is not null and y is not null")
        .groupBy("col1", "col2", "x", "y")
        .agg(F.sum("weight").alias("n"))
    )


def chi_square(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, r, k, dof, chi2)`` from ``(*by, x, y, n)`` cells.

    Only observed cells are needed: the empty ones cancel out in ``n * (sum O²/(RC) - 1)``.
    With one degree of freedom the continuity correction applies; there all four deviations are
    equal, so margins and one cell give the corrected sum.
    """
    by = list(by)
    row, column = Window.partitionBy(*by, "x"), Window.partitionBy(*by, "y")
    framed = cells.select(
        *by, "x", "y", "n",
        F.sum("n").over(row).alias("r_sum"), F.count("n").over(row).alias("r_cells"),
        F.sum("n").over(column).alias("c_sum"), F.count("n").over(column).alias("c_cells"),
    )
    o, r_sum, c_sum = (F.col(c).cast("double") for c in ("n", "r_sum", "c_sum"))
    sums = framed.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.sum(1.0 / F.col("r_cells")).alias("r_raw"),
        F.sum(1.0 / F.col("c_cells")).alias("k_raw"),
        F.sum(o * o / (r_sum * c_sum)).alias("ratio"),
        F.sum(1.0 / (r_sum * F.col("r_cells"))).alias("inv_r"),
        F.sum(1.0 / (c_sum * F.col("c_cells"))).alias("inv_c"),
        F.first(F.struct(o.alias("o"), (r_sum * c_sum).alias("rc"))).alias("cell"),
    )
    n = F.col("total").cast("double")
    gap = F.abs(F.col("cell.o") - F.col("cell.rc") / n)
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) * n * F.col("inv_r") * F.col("inv_c")
    plain = F.greatest(F.lit(0.0), n * (F.col("ratio") - 1.0))
    shaped = sums.withColumns(
        {"r": F.round("r_raw").cast("long"), "k": F.round("k_raw").cast("long")}
    )
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    chi2 = F.when(dof == 0, F.lit(0.0)).when(dof == 1, corrected).otherwise(plain)
    return shaped.select(
        *by, F.col("total").alias("n"), "r", "k", dof.alias("dof"), chi2.alias("chi2")
    )


def cramers_v(tests: DataFrame) -> DataFrame:
    """Add ``v``, the bias-corrected Cramér's V, to the output of :func:`chi_square`."""
    n, r, k = (F.col(c).cast("double") for c in ("n", "r", "k"))
    rest = F.nullif(n - 1, F.lit(0.0))
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / rest)
    r_corr = r - F.pow(r - 1, 2) / rest
    k_corr = k - F.pow(k - 1, 2) / rest
    room = F.nullif(F.least(k_corr - 1, r_corr - 1), F.lit(0.0))
    return tests.withColumn("v", F.coalesce(F.sqrt(phi2 / room), F.lit(0.0)))


def cramers_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return cramers_v(chi_square(contingency(df, x, y)))


def cramers_matrix(df: DataFrame, columns: Sequence[str], missing: str = "Unknown") -> DataFrame:
    """``(col1, col2, v)`` for all ordered pairs, diagonal included; NULL is a category."""
    filled = df.select(*columns).na.fill(missing)
    tests = cramers_v(chi_square(pair_cells(filled, columns), ["col1", "col2"]))
    both = F.array(
        F.struct("col1", "col2", "v"),
        F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "v"),
    )
    one = F.slice(both, 1, 1)
    return tests.select(F.inline(F.when(F.col("col1") == F.col("col2"), one).otherwise(both)))
