"""CSV and parquet scans and sinks, feature-matrix and vocabulary storage."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Cell texts that mean "missing" in a CSV file.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_CSV_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def null_tokens_to_null(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Turn every missing-value token of the string columns into NULL."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) if c in strings else F.col(c)
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV scan with header, quoted multi-line text and missing-value tokens.

    Types are never guessed: without a schema all columns are strings named by the header. Quoted
    line breaks make a file unsplittable, so parallelism comes from the number of files;
    :func:`write_csv` bounds the rows per file for that reason. Files without quoted line breaks
    split with ``multi_line=False``.
    """
    reader = spark.read.options(**_CSV_DIALECT).option("multiLine", multi_line)
    raw = (reader.schema(schema) if schema is not None else reader).csv(path)
    return null_tokens_to_null(raw)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV sink: header, no row index, many files of bounded length."""
    (
        df.write.options(**_CSV_DIALECT)
        .option("emptyValue", "")
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The stored layout of a sparse vector; parquet keeps the vector type as this struct.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def write_features(sparse: DataFrame, path: str) -> None:
    """Save a feature matrix; ``features`` is a :data:`SPARSE` struct or a vector."""
    sparse.write.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Load a feature matrix with ``features`` as a Spark ML vector column."""
    stored = spark.read.parquet(path).schema
    schema = T.StructType(
        [
            T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
            for f in stored.fields
        ]
    )
    return spark.read.schema(schema).parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Save a fitted vectoriser: its vocabulary relation is all it consists of."""
    vocabulary.write.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
