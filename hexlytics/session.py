"""Session helpers: a sensible local session, and the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_ANY_SIZE = 1 << 100  # bytes


def build_session(app: str = "hexlytics", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Checkpoints go when the frames that need them are gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Wide projections make methods the JVM will not compile; above this size Spark
        # generates small ones instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="hexlytics-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A machine-local folder is used only by a local master, one per application, removed when
    Python ends; a cluster without the setting is an error, since executors could not read each
    other's files.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master.startswith("local"):
        return _local_folder(context.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into reliable storage; survives executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _with_bounded_size(df.checkpoint())


def _with_bounded_size(kept: DataFrame) -> DataFrame:
    """A checkpoint keeps the size its plan was estimated at, and a join's is the product of its
    sides': over rounds of joins the digits of that number multiply until they fill the driver.
    Beyond any real size, the rows go on as a frame of unknown size."""
    run, spark = kept._jdf.queryExecution(), kept.sparkSession
    if run.optimizedPlan().stats().sizeInBytes() < _ANY_SIZE:
        return kept
    return DataFrame(
        spark._jsparkSession.internalCreateDataFrame(run.toRdd(), kept._jdf.schema(), False), spark)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies; what is not there stays away."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def open_writers(spark: SparkSession, most: int = 64) -> Iterator[None]:
    """Writes inside keep the files of up to ``most`` partitions open in a task, so rows go out as
    they come; without it Spark sorts all rows of a task by partition first, and a large task
    spills them. Partitions beyond ``most`` are sorted as before."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
