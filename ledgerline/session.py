"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerline") -> SparkSession:
    """Session used by tests and the benchmark.

    On a cluster the submitter sets these; here they are the local defaults:
    UTC session time (dates and 90-day look-backs must not move with the
    driver's zone), AQE on (runtime broadcast conversion with its size check,
    skew-join splitting, partition coalescing).
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def compiled_code(spark: SparkSession) -> None:
    """The JVM never compiles a method of over 8000 bytes, but Spark generates
    them up to 65535: long projections then run interpreted. From 8000 on they
    are to be computed by Spark's projections in pieces. A limit that the
    session was given stays."""
    if spark.conf.get(HUGE_METHOD) == "65535":
        spark.conf.set(HUGE_METHOD, "8000")


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
_LOCAL_CHECKPOINT_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, making a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is (it is a launch-time setting and cannot be changed on a running
    session). A machine-local temporary folder is only created for local runs,
    once per application.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = _LOCAL_CHECKPOINT_DIRS.get(sc.applicationId)
        if current is None:
            current = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
            _LOCAL_CHECKPOINT_DIRS[sc.applicationId] = current
    sc.setCheckpointDir(current)
    return current


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings while a query begins and ends in here."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Files of a query's exchanges are removed at its end; else they stay until the driver collects its garbage. For
# writes: what is written is read from its table, not computed again.
EXCHANGES_DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Rows of one folder lie together already: a file for each that a task meets stays open, instead of sorting the rows
# by folder. Past so many folders in a task the rest is sorted.
FOLDERS_OPEN = {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "16"}


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: what reads
    it more than once does not compute it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ledgerline/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, EXCHANGES_DROPPED):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
