"""Lineage cuts: tables written once to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

# Spark's setting: a query's shuffle files go when it ends, not when the driver's garbage is collected.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUN = f"casebook-{uuid.uuid4().hex}"
# Paths of what is staged while a function of :func:`stage_alone` runs.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    ``spark.checkpoint.dir`` decides. Only a session whose executors are threads of this process
    may leave it unset; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="casebook-")
    context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where this process stages its tables."""
    return f"{shared_folder(spark).rstrip('/')}/{_RUN}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path that Spark can read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(place).getLength()


def listing(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(
        (f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(place)
    )


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has staged; frames that read them end here."""
    _delete(spark, run_folder(spark))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as parquet, with the writer's options, and return the scan of it.

    Used where a result is read several times (tokens, vocabulary, features, predictions).
    Unlike a cache it survives the loss of executors, and later reads prune columns. What was
    shuffled for it leaves the executors' disks once it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (made := _ON_THE_WAY.get()) is not None:
        made.append(path)
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """:func:`stage` of what ``make`` returns; the tables that it staged on the way are deleted then."""
    made: list[str] = []
    token = _ON_THE_WAY.set(made)
    try:
        df = make()
    finally:
        _ON_THE_WAY.reset(token)
    out = stage(df, name)
    for path in made:
        _delete(df.sparkSession, path.rpartition("/")[0])
    return out


#: Bytes of an Arrow batch between Spark and Python, on both sides of the pipe.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Batches by bytes: texts and token lists are long, and every batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the files behind ``df`` give fewer splits than the session has slots.

    The splits are told from the number and size of the files: no job runs. A large table has
    more splits than slots and is left alone: no shuffle.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= slots:
        return df
    width = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = sum(-(-size_of(spark, f) // width) for f in files)
    return df.repartition(slots) if splits < slots else df


def compact(df: DataFrame, bytes_per_task: int = 32 << 20) -> DataFrame:
    """Fewer, larger splits where the files behind ``df`` are small, without a shuffle.

    For iterative fits, where every task of every pass costs more than its rows do. There are no fewer
    splits than the session has slots.
    """
    size = sum(size_of(df.sparkSession, f) for f in df.inputFiles())
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(slots, size // bytes_per_task + 1)) if size else df


def bounded(df: DataFrame, limit: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A broadcast hint for ``df`` if it is small in rows and in bytes, else ``df`` as it is.

    Bytes are those of the files behind ``df`` (a staged table; a narrower or filtered one has
    fewer), which are read from the listing; rows are counted up to the limit. Without the hint
    Spark joins by shuffle and splits hot keys at run time.
    """
    small = sum(size_of(df.sparkSession, f) for f in df.inputFiles()) <= most_bytes
    return F.broadcast(df) if small and df.limit(limit + 1).count() <= limit else df
