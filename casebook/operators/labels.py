"""Projection, filters, dates and label regrouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_date(text: Column, fmt: str = "yyyy-MM-dd", lenient: bool = False) -> Column:
    """Text to date. Bad text is an error; ``lenient`` makes it NULL."""
    if lenient:
        return F.try_to_date(text, fmt)
    return F.to_date(text, fmt)


def with_date_parts(df: DataFrame, date_column: str) -> DataFrame:
    """Add ``year_received`` and ``month_received``."""
    return df.withColumns(
        {"year_received": F.year(date_column), "month_received": F.month(date_column)}
    )


def project(df: DataFrame, columns: Sequence[str], names: Mapping[str, str] = {}) -> DataFrame:
    """Keep ``columns``, renamed where ``names`` says so."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in columns])


def members(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is in the list, or in the first column of a table."""
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi").select(*df.columns)
    return df.where(F.col(column).isin(list(values)))


def mapping_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """A label map held in code as a ``(label, label_group)`` table."""
    rows = [
        F.struct(F.lit(k).alias("label"), F.lit(v).alias("label_group"))
        for k, v in mapping.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def regroup(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str] | DataFrame,
    out: str,
    default: str | None = None,
) -> DataFrame:
    """Map ``column`` through a label map into ``out``; a miss gives ``default`` (or NULL).

    A map held in code is as small as the code and is broadcast. A ``(label, label_group)``
    table given by the caller is joined without a hint: Spark checks its size.
    """
    if isinstance(mapping, DataFrame):
        table = mapping
    else:
        table = F.broadcast(mapping_table(df.sparkSession, mapping))
    joined = df.join(table, F.col(column) == F.col("label"), "left").drop("label")
    value = F.col("label_group")
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return joined.withColumn(out, value).drop("label_group")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def percent_text(share: Column) -> Column:
    """``0.1234`` as ``12.3%``."""
    return F.format_string("%.1f%%", 100.0 * share)
