"""Exact, reproducible stratified splits and folds without sorting a whole class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.functions.hashing import hash_bucket
from casebook.sources.staging import bounded, stage

# A class is cut into this many hash ranges; only one range at a time is put in order.
RANGE_BITS = 16


def _keyed(df: DataFrame, id_column: str, stratum: str, salt: str) -> DataFrame:
    h = hash_bucket(salt, F.col(id_column))
    return df.select(
        F.col(id_column).alias("id"), F.col(stratum).alias("stratum"), h.alias("h"),
        F.shiftright(h, 32 - RANGE_BITS).alias("range"),
    ).where("stratum is not null")


def _range_offsets(keyed: DataFrame) -> DataFrame:
    """``(stratum, range, n, before)``, staged: at most ``2**RANGE_BITS`` rows per class."""
    so_far = Window.partitionBy("stratum").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = keyed.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    return stage(
        counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "offsets"
    )


def _edges(keyed: DataFrame, offsets: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(stratum, at, edge)``: the ``(h, id)`` at each wanted rank of ``ranks (stratum, at)``.

    Ranks are 1-based in the order ``(hash, id)`` of a class. Only the hash ranges that hold a
    wanted rank are put in order, so no task ever holds a class.
    """
    holding = stage(
        offsets.join(ranks, "stratum")
        .where((F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("n")))
        .drop("n"),
        "ranges",
    )
    inside = F.row_number().over(Window.partitionBy("stratum", "range", "at").orderBy("h", "id"))
    return (
        keyed.join(bounded(holding), ["stratum", "range"])
        .withColumn("rank", F.col("before") + inside)
        .where("rank = at")
        .select("stratum", "at", F.struct("h", "id").alias("edge"))
    )


def test_quotas(sizes: DataFrame, test_share: float) -> DataFrame:
    """``(stratum, n, quota)`` from ``(stratum, n)``: the test rows each class gives.

    The total is ``ceil(share * rows)``; classes get their proportional share rounded down and
    the remaining places go to the largest remainders (ties by class name).
    """
    everything = Window.partitionBy()
    n, total = F.col("n"), F.sum("n").over(everything)
    wanted = F.ceil(F.round(F.lit(test_share) * total, 9))
    share = sizes.withColumns({"total": total, "wanted": wanted}).withColumn(
        "exact", F.col("wanted") * n / F.col("total")
    )
    floored = share.withColumn("base", F.floor("exact"))
    order = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "stratum")
    spare = F.col("wanted") - F.sum("base").over(everything)
    extra = (F.row_number().over(order) <= spare).cast("long")
    return floored.select("stratum", "n", (F.col("base") + extra).alias("quota"))


def _with_interval(
    df: DataFrame, id_column: str, stratum: str, salt: str, edges: DataFrame, out: str
) -> DataFrame:
    """Add the number of edges of the row's class that lie below the row.

    The edges of a class are one array, so there is one row per class.
    """
    by_class = stage(
        edges.groupBy(F.col("stratum").alias(stratum)).agg(F.collect_list("edge").alias("_edges")),
        "edges",
    )
    below = edges_below(F.col("_edges"), id_column, salt)
    return (
        df.where(F.col(stratum).isNotNull())
        .join(bounded(by_class), stratum, "left")
        .withColumn(out, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(below))
        .select(*df.columns, out)
    )


def split_labels(
    df: DataFrame, id_column: str, stratum: str, test_share: float = 0.2, salt: str = "split-42"
) -> DataFrame:
    """Add ``is_test``: exactly the quota of each class, chosen by hash order.

    Only the hash value at which a class reaches its quota is looked up, in two passes over ids
    and labels; all rows then compare themselves with it, so the table itself is not shuffled.
    Rows without a class are dropped.
    """
    keyed = _keyed(df, id_column, stratum, salt)
    offsets = _range_offsets(keyed)
    sizes = offsets.groupBy("stratum").agg(F.sum("n").alias("n"))
    quotas = test_quotas(sizes, test_share)
    edges = _edges(
        keyed, offsets, quotas.where("quota > 0").select("stratum", F.col("quota").alias("at"))
    )
    # a class without test rows gets an edge below every row
    none = quotas.where("quota = 0").select(
        "stratum", F.col("quota").alias("at"),
        F.struct(F.lit(-1).cast("long").alias("h"), F.lit(0).cast("long").alias("id")).alias("edge"),
    )
    placed = _with_interval(df, id_column, stratum, salt, edges.unionByName(none), "_above")
    return placed.withColumn("is_test", F.col("_above") == 0).drop("_above")


def stratified_split(
    df: DataFrame, id_column: str, stratum: str, test_share: float = 0.2, salt: str = "split-42"
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` with equal class shares."""
    labelled = split_labels(df, id_column, stratum, test_share, salt)
    return labelled.where("not is_test").drop("is_test"), labelled.where("is_test").drop("is_test")


def with_folds(
    df: DataFrame,
    id_column: str,
    stratum: str,
    k: int = 5,
    salt: str = "fold-42",
    group_column: str | None = None,
    out: str = "fold",
) -> DataFrame:
    """Add a fold number ``0 .. k-1``; within a class the folds differ by one row at most.

    A fold is an interval of the hash order of its class, found like the split above. With
    ``group_column`` all rows of a group share the fold of its hash (paraphrases stay with their
    source); fold sizes are then equal in expectation only.
    """
    if group_column is not None:
        fold: Column = F.pmod(hash_bucket(salt, F.col(group_column)), F.lit(k))
        return df.withColumn(out, fold.cast("int"))
    return _with_interval(
        df, id_column, stratum, salt, fold_edges(df, id_column, stratum, k, salt), out)


def fold_edges(df: DataFrame, id_column: str, stratum: str, k: int, salt: str) -> DataFrame:
    """``(stratum, at, edge)``: where the folds of a class end, the last one left out."""
    keyed = _keyed(df, id_column, stratum, salt)
    offsets = _range_offsets(keyed)
    n, j = F.col("n"), F.col("j")
    ends = (
        offsets.groupBy("stratum")
        .agg(F.sum("n").alias("n"))
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
        .select("stratum", (j * F.floor(n / k) + F.least(j, n % k)).alias("at"))
        .where("at > 0")
        .distinct()
    )
    return _edges(keyed, offsets, ends)


def edges_below(edges: Column, id_column: str, salt: str) -> Column:
    """The number of a list of edges that lie below the row."""
    own = F.struct(hash_bucket(salt, F.col(id_column)).alias("h"), F.col(id_column).alias("id"))
    return F.size(F.filter(edges, lambda e: e < own))
