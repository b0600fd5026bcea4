"""The tables the queries run on, derived from the star-schema and document parquet files.

``complaints`` is an order seen as a case record, ``narratives`` a document with its labels,
``flags`` a two-by-two pair, ``predictions`` a classifier's output drawn from hashes. All use
every row of their source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.functions.hashing import HASH_RANGE, hash_bucket
from casebook.sources.tables import read_table

# Language and label pairs as case labels of the taxonomies.
ISSUE_OF_LANG = {
    "en": "Getting a loan",
    "fr": "Struggling to repay your loan",
    "de": "Incorrect information on your report",
    "es": "Dealing with your lender or servicer",
}
SUB_ISSUE_OF_LABELS = {
    (0, 0): "Payment issues",
    (0, 1): "Denied loan",
    (1, 0): "Problem with customer service",
    (1, 1): "Account information incorrect",
}
LANGS = ["de", "en", "es", "fr"]


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order. ``timely`` and ``submitted_via`` hold NULLs."""
    orders, customer, nation, region = (
        read_table(spark, folder, t) for t in ("orders", "customer", "nation", "region")
    )
    day = F.to_date("o_orderdate")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 rows
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # 5 rows
        .select(
            F.col("o_orderkey").alias("complaint_id"),
            F.date_format(day, "yyyy-MM-dd").alias("received_text"),
            day.alias("date_received"),
            F.date_add(day, F.col("c_nationkey")).alias("date_sent"),
            F.lit("loan").alias("product"),
            F.col("r_name").alias("issue"),
            F.col("n_name").alias("sub_issue"),
            F.col("c_mktsegment").alias("company"),
            F.concat(F.lit("S"), F.right("c_name", F.lit(2))).alias("state"),
            F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("submitted_via"),
            F.when(F.col("o_orderstatus") == "F", "No")
            .when(F.col("o_orderstatus") == "O", "Yes")
            .alias("timely"),
            F.col("o_orderstatus").alias("response"),
        )
    )


def narrated(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints with a narrative where a document has the same number, else NULL."""
    texts = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative")
    )
    return complaints(spark, folder).join(texts, "complaint_id", "left")


def narratives(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, narrative, issue, sub_issue)``; ``sub_issue`` is NULL where unlabelled."""
    issue = F.lit(None).cast("string")
    for lang, label in ISSUE_OF_LANG.items():
        issue = F.when(F.col("lang") == lang, label).otherwise(issue)
    sub_issue = F.lit(None).cast("string")
    for (quality, toxic), label in SUB_ISSUE_OF_LABELS.items():
        own = (F.col("quality") == quality) & (F.col("toxic") == toxic)
        sub_issue = F.when(own, label).otherwise(sub_issue)
    return (
        read_table(spark, folder, "documents")
        .join(read_table(spark, folder, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("text").alias("narrative"),
            issue.alias("issue"),
            sub_issue.alias("sub_issue"),
        )
    )


def flags(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("x"), (F.col("l_returnflag") == "A").cast("string").alias("y")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, y_true, y_pred, conf, classes, p1, p2)`` for every document."""
    key = F.col("doc_id")

    def unit(salt: str):
        return hash_bucket(salt, key) / F.lit(HASH_RANGE)

    def distribution(prefix: str):
        draws = [hash_bucket(f"{prefix}{i}", key) + 1 for i in range(len(LANGS))]
        total = sum(draws[1:], draws[0])
        return F.array(*[d / total for d in draws])

    classes = F.array(*[F.lit(c) for c in LANGS])
    other = F.element_at(classes, (F.pmod(hash_bucket("q", key), F.lit(4)) + 1).cast("int"))
    return read_table(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("y_true"),
        F.when(unit("p") < 0.8, F.col("lang")).otherwise(other).alias("y_pred"),
        F.round(unit("c"), 4).alias("conf"),
        classes.alias("classes"),
        distribution("a").alias("p1"),
        distribution("b").alias("p2"),
    )
