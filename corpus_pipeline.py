"""From raw documents to packed training sequences, stage by stage.

Every filtering stage returns the columns of ``documents`` for the rows that it keeps:

1. language ID drops texts without a letter and texts that no language is likely for;
2. exact dedup keeps one row of each group of equal texts;
3. n-gram join keeps one row, of the smallest id, of each component of similar texts;
4. decontamination drops documents that hold benchmark passages by the twentieth-of-words rule;
5. packing returns the pieces of the token sequences.

Decisions are joined back by document id and text, as rows may share an id: by the digest of the
normalised text after exact dedup, by a 64-bit hash of id and text in the next two stages. Of rows
that repeat an id and a text, one stays. Rows without an id are judged by their
language and text alone. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.llm import exact_dedup, language, ngram_join, packing, phrase_index
from casebook.sources.staging import bounded, lean, stage, stage_alone
from casebook.sources.tables import read_table

LEAST_SCORE = 0.3
BROADCAST_ROWS = 1_000_000


def _rows(docs: DataFrame, **keys) -> DataFrame:
    """Whole rows as one column beside the given keys, so that no names clash."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        *[column.alias(name) for name, column in keys.items()],
    )


def _without(rows: DataFrame, find: Callable[[], DataFrame], keys: list[str]) -> DataFrame:
    """``rows`` but for the keys that ``find`` returns: broadcast while these are few, else shuffled.

    What ``find`` stages on the way is deleted once the keys are found."""
    out = stage_alone(lambda: find().distinct(), "out")
    return rows.join(bounded(out, BROADCAST_ROWS), keys, "left_anti")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    net = language.learn(docs)
    found = language.predict(net, F.col("text"))
    judged = _rows(docs, found=found)
    kept = judged.where(
        (F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE))
    return kept.select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stage_alone(lambda: exact_dedup.equal_texts(docs.select("doc_id", "text")), "exact")
    keys = [F.col("doc_id"), F.col("text_sha256")]
    # A pair that repeats: its rows can't be told apart, one of them stays if one is kept.
    pairs = groups.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1")
    repeated = stage(pairs.select("doc_id", "text_sha256", "kept"), "repeated")
    out = groups.where(~F.col("kept")).select("doc_id", "text_sha256")
    null_safe = {"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))}
    out = out.union(repeated.select("doc_id", "text_sha256")).select(
        null_safe["id"].alias("id"), F.col("text_sha256").alias("digest"))
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rows = _rows(docs, digest=digest, **null_safe)
    kept = _without(rows, lambda: out, ["id", "digest"]).select("row.*")
    if repeated.where("kept").isEmpty():
        return kept
    again = repeated.where("kept").select(
        null_safe["id"].alias("id"), F.col("text_sha256").alias("digest"))
    ones = rows.join(again, ["id", "digest"]).dropDuplicates(["id", "digest"])
    return kept.unionByName(ones.select("row.*"))


def _key() -> F.Column:
    """Tells rows of one id apart by their texts; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    keyed = docs.select("doc_id", _key().alias("key"), "text")

    def dropped() -> DataFrame:
        found = ngram_join.similar(keyed.select(F.col("key").alias("doc_id"), "text"))
        moved = found.where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id")
        groups = stage(moved.groupBy("component_id").agg(
            F.count_distinct("key").alias("n")).where("n > 1").select("component_id"), "near_groups")
        members = stage(
            moved.join(bounded(groups, BROADCAST_ROWS), "component_id", "left_semi").distinct(), "near")
        ids = keyed.select("key", "doc_id").join(bounded(members, BROADCAST_ROWS), "key")
        best = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("best"))
        return members.join(best.select("best.key"), "key", "left_anti").select("key")

    return _without(_rows(docs, key=_key()), dropped, ["key"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)

    def dropped() -> DataFrame:
        found = phrase_index.matches(
            docs.select(_key().alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
        judged = phrase_index.contamination(found).where("contaminated")
        return judged.select(F.col("doc_id").alias("key"))

    return _without(_rows(docs, key=_key()), dropped, ["key"]).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("packing", packed),
]

# The language model's weights come from an iterative fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
