"""Groups of equal texts by most-significant-first radix partitioning over their bytes.

Texts are compared without the white space ``[\\x20\\x09-\\x0D]``. The first round splits the
documents by their first bytes, each later one splits the groups that are left by the next bytes,
with digits that widen from round to round, until a group holds one document or its texts have
ended. The bytes themselves are the grouping keys: nothing is taken as equal because of a digest.

Counts are combined in the map tasks before they are shuffled, so a group that holds a third of
all rows is one row per task; its rows meet the small count table in a join that Spark splits.

Null text counts as empty; all empty texts are one group. Of equal texts the one with the most
code points stays, then the smallest id, null ids last. Among repeated rows of the id that stays
exactly one is kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casebook.sources.staging import bounded, stage

FIRST_BYTES = 48
WIDER = 8
MOST_BYTES = 1 << 20


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _split(rows: DataFrame, by: list[str], width: int, name: str) -> DataFrame:
    """One round: rows with the size and best row of their group, the rest of open texts.

    Columns added: ``n`` and ``best`` (null for single rows), ``part`` and ``rest`` (null
    unless the group goes on).
    """
    digit = rows.withColumn("digit", F.substring("rest", 1, width))
    keys = [*by, "digit"]
    groups = (
        digit.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("low"))).alias("best"),
        )
        .where("n > 1")
        .withColumn("part", F.monotonically_increasing_id())
    )
    groups = stage(groups, f"{name}_groups")
    joined = digit.join(bounded(groups), keys, "left")
    goes_on = F.col("n").isNotNull() & (F.octet_length("digit") == width)
    split = joined.select(
        "doc_id",
        "n_chars",
        "text_sha256",
        "n",
        "best",
        "part",
        F.when(goes_on, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
    )
    return stage(split, name)


def equal_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    text = normalised(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"),
        text.cast("binary").alias("rest"),
    )
    width, by, done, turn = FIRST_BYTES, [], [], 0
    while True:
        split = _split(rows, by, width, f"radix{turn}")
        done.append(
            split.where("rest is null").select(
                "doc_id", "n_chars", "text_sha256", "n", "best",
                F.concat_ws("/", F.lit(str(turn)), F.col("part").cast("string")).alias("part"),
            )
        )
        rows = split.where("rest is not null").select(
            "doc_id", "n_chars", "text_sha256", "rest", F.col("part").alias("group")
        )
        if rows.isEmpty():
            break
        by, turn, width = ["group"], turn + 1, min(width * WIDER, MOST_BYTES)
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    single = ended.where("n is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    grouped = ended.where("n is not null").withColumn("keep_id", -F.col("best.low"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (
        F.col("n_chars") == F.col("best.n_chars")
    )
    again = Window.partitionBy("part", "doc_id").orderBy("n_chars")
    kept = grouped.where(best).withColumn("kept", F.row_number().over(again) == 1)
    dropped = grouped.where(~best).withColumn("kept", F.lit(False))
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256"]
    return single.unionByName(kept.select(*columns)).unionByName(dropped.select(*columns))
