"""Session defaults, shared storage and size-checked hints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have, by proof or by count, to be broadcast.
BROADCAST_ROWS = 200_000
# Whether Spark drops a query's shuffle files at its end instead of when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs. On a cluster pass the cluster's own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quarrylight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in a local session without it.

    On a cluster the executors do not share local disks, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        one_machine = context.master == "local" or context.master.startswith("local[")
        if configured is None and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quarrylight-"))
    return configured or context.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run on workers refer to the package by name, and a cluster's
    workers do not share the driver's import path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already running from a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarrylight-"), "quarrylight_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder for a written table."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/quarrylight/{app}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with its statistics.

    What was shuffled for it is dropped once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spilled: DataFrame) -> None:
    """Delete the folder that :func:`spill` wrote; nothing that is still to be run may read it."""
    jvm = spilled.sparkSession.sparkContext._jvm
    for folder in {os.path.dirname(name) for name in spilled.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spilled.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(df: DataFrame, bound: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its proven row bound is within ``limit``.

    Without a proof, or beyond the limit, Spark chooses a shuffle join and AQE
    splits skewed partitions.
    """
    return F.broadcast(df) if bound is not None and bound <= limit else df


def bounded_count(df: DataFrame, limit: int) -> int | None:
    """Row count of ``df`` when at most ``limit``, else None. Reads at most limit+1 rows."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than the cluster has cores.

    Small inputs arrive in one split; large ones already have more splits than
    cores and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
