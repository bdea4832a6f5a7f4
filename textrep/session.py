"""Session helpers: local test sessions and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Spark knows it from 4.1 on; older versions ignore it.
FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "textrep", cpus: str | int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there the
    driver and the executors are one process.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textrep-"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key when the input has fewer partitions than cores.

    A file of one row group is read by one task. Larger inputs, which have more
    splits than the cluster has cores, pass unchanged and without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def even_keys(spark: SparkSession, count: int) -> list[int]:
    """``count`` numbers that a shuffle on an int column deals evenly to its partitions.

    Numbers in a row meet by chance in some partitions and leave others empty.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted, tried, of = -(-count // partitions), 0, {}
    while sum(min(len(keys), wanted) for keys in of.values()) < min(count, partitions * wanted):
        some = spark.range(tried, tried + 8 * max(count, partitions)).select(F.col("id").cast("int").alias("id"))
        for row in some.select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("to")).collect():
            of.setdefault(row["to"], []).append(row["id"])
        tried += 8 * max(count, partitions)
    return [key for _, _, key in sorted((turn, to, key) for to, keys in of.items() for turn, key in enumerate(keys[:wanted]))[:count]]


def cut_lineage(df: DataFrame, name: str, free: bool = False, **options: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Later scans start from these files, so a lost executor never replays the
    jobs before them, and the rows are computed once. With ``free`` the shuffle
    files behind them go when they are written, not when the driver next collects
    its garbage. ``options`` are those of the Parquet writer.
    """
    path = work_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession) if free else nullcontext():
        df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here are deleted at its end."""
    before = spark.conf.get(FREE_CONF, None)
    spark.conf.set(FREE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_CONF) if before is None else spark.conf.set(FREE_CONF, before)
