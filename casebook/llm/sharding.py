"""Weighted rendezvous hashing of record keys over shards.

Every shard draws a number from the key and its own index; the largest draw, stretched by the
shard's weight, wins. A new shard only takes the keys it wins, so no key moves between old shards.

Null keys hash like the text ``null``; rows with equal keys share a shard. Sizes count the UTF-8
bytes of the text plus eight, so a null or empty text has size 8 and checksum 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 24
ROW_BYTES = 8
CHUNK_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the digest of key and shard."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def key_text(*columns: str) -> Column:
    """The key columns as one text; lengths keep neighbouring columns apart."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    if len(texts) == 1:
        return texts[0]
    return F.concat_ws("/", *[F.concat_ws(":", F.length(t).cast("string"), t) for t in texts])


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The index of the shard that wins ``key``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [
        F.struct((F.lit(-float(w)) / F.ln(_draw(key, s))).alias("score"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scores))["shard"]


def assign(
    df: DataFrame,
    key_columns: Sequence[str],
    weights: Sequence[float],
    shard_column: str = "shard",
) -> DataFrame:
    """``df`` with the shard of every row."""
    return df.withColumn(shard_column, shard_of(key_text(*key_columns), weights))


def with_slots(df: DataFrame, key: Column, shard_column: str, order: Sequence[str]) -> DataFrame:
    """Gapless places from 0 in each shard, without a task that sees a whole shard.

    Rows are numbered within small hash chunks of a shard; the counts of the chunks before them,
    a table of at most shards x 4096 rows, give the start.
    """
    chunked = df.withColumn("_chunk", F.substring(F.md5(key), 1, CHUNK_DIGITS))
    before = Window.partitionBy(shard_column).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        chunked.groupBy(shard_column, "_chunk")
        .agg(F.count("*").alias("_rows"))
        .select(
            shard_column,
            "_chunk",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        )
    )
    within = Window.partitionBy(shard_column, "_chunk").orderBy(*order)
    numbered = chunked.withColumn("_place", F.row_number().over(within) - 1)
    return (
        numbered.join(starts, [shard_column, "_chunk"])
        .withColumn("slot", F.col("_start") + F.col("_place"))
        .drop("_chunk", "_start", "_place")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's shard, its place there and its shard if one shard were added."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = key_text("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, [1.0] * shards).alias("shard"),
        shard_of(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slots(rows, key, "shard", ["doc_id", "size", "text_crc32"])


def write_shards(df: DataFrame, path: str, shard_column: str = "shard") -> None:
    """One folder per shard; several tasks share a large shard."""
    df.write.partitionBy(shard_column).parquet(path)
