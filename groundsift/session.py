"""Session helpers. Every job takes a SparkSession from the caller; nothing here owns one."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: whether a query's shuffle files go when it has ended, and not when the driver happens to collect its garbage
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("groundsift")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder the cluster names.

    A temporary folder is used only on a local master that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-groundsift-", dir="/tmp")
    context.setCheckpointDir(folder)


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are run inside go when each has ended; the caller's setting comes back."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends there.

    A written table also brings its true size to the next join, and starts
    without the constraints a checkpointed plan carries along, which double
    with every self join of an iterative job.  Nothing reads its shuffles any
    more, so they go as soon as it is written.
    """
    path = scratch_folder(df.sparkSession, "cut")
    with shuffles_end_with_query(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """A join side that grows with the data and is not to be broadcast.

    A plan takes a table for as large as its compressed files, before its rows
    are exploded and its texts made, and would send it whole through the driver.
    """
    return df.hint("merge")


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for callers that need the partitions and their order kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for written intermediate tables."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_groundsift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-groundsift-', dir='/tmp')}/groundsift", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._groundsift_shipped = True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by ``keys`` into the configured number of shuffle partitions.

    Goes before grouped Python work: its cost is in the groups, not the bytes,
    and adaptive execution would merge small partitions into few tasks.  The
    grouping that follows reuses this partitioning.
    """
    ship_package(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
