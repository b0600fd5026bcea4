"""Column profile, duplicates and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def schema_counts(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null)`` for every column, from one aggregate row."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("non_null"))
        for c, t in df.dtypes
    ]
    return counts.select(F.inline(F.array(*rows)))


DIGEST_FROM = 32  # bytes; a longer value is compared by its 256-bit digest


def _value_key(df: DataFrame, name: str) -> Column:
    """A short binary value that is equal for equal cells only; NULL stays NULL."""
    kind, cell = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        cell = cell + F.lit(0.0)  # one zero
    elif isinstance(kind, T.TimestampType):
        cell = F.unix_micros(cell)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        cell = F.when(cell.isNotNull(), F.to_json(F.struct(cell)))
    text = cell if isinstance(kind, T.BinaryType) else cell.cast("string").cast("binary")
    return F.when(F.octet_length(text) < DIGEST_FROM, text).otherwise(F.unhex(F.sha2(text, 256)))


def column_overview(df: DataFrame, approximate: Sequence[str] = ()) -> DataFrame:
    """Type, distinct values, NULLs, NULL share and a zero-variance flag per column.

    Ordered by NULL share, then name. Distinct counts are exact and leave NULL out; columns
    named in ``approximate`` use a sketch instead (wide tables, near-unique long text). A row
    gives one short key per column, counted in the map tasks; no long text is shuffled.
    """
    exact = [c for c in df.columns if c not in approximate]
    keys = [F.struct(F.lit(-1).alias("place"), F.lit(b"").alias("key"))] + [
        F.struct(F.lit(i).alias("place"), _value_key(df, c).alias("key")) for i, c in enumerate(exact)
    ]
    counted = (
        df.select(F.inline(F.array(*keys)))
        .groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("place").agg(
            F.count("key").alias("n_distinct"),
            F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        )
        .agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("n_distinct", "n")))).alias("at"))
    )
    if approximate:
        sketched = df.agg(*[
            F.struct(F.approx_count_distinct(c).alias("n_distinct"), F.count(c).alias("n")).alias(f"sketch{i}")
            for i, c in enumerate(approximate)
        ])
        counted = counted.crossJoin(sketched)  # one row each

    def found(c: str, part: str) -> Column:
        cell = F.col(f"sketch{list(approximate).index(c)}") if c in approximate else F.try_element_at(
            "at", F.lit(exact.index(c)))
        return F.coalesce(cell.getField(part), F.lit(0))

    rows_ = F.coalesce(F.try_element_at("at", F.lit(-1)).getField("n"), F.lit(0))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("dtype"),
            found(c, "n_distinct").alias("n_distinct"),
            (rows_ - found(c, "n")).alias("n_null"),
            rows_.alias("n_rows"),
        )
        for c, t in df.dtypes
    ]
    return (
        counted.select(F.inline(F.array(*rows)))
        .select(
            "column",
            "dtype",
            "n_distinct",
            "n_null",
            F.try_divide(100.0 * F.col("n_null"), F.col("n_rows")).alias("null_pct"),
            (F.col("n_distinct") <= 1).alias("zero_variance"),
        )
        .orderBy(F.desc("null_pct"), "column")
    )


def zero_variance_columns(df: DataFrame) -> DataFrame:
    """Names of the columns that hold one value at most, by their least and largest value."""
    ends = df.agg(*[
        F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(c) for c in df.columns
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("constant")) for c in df.columns
    ])
    return ends.select(F.inline(rows)).where("constant").select("column")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy; NULL equals NULL. Rows meet as 256-bit digests."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    copies = df.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def fill_category(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.na.fill(value, subset=list(columns))
