"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("proofspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # lists are collected for very many small groups; the default of 128 groups would sort almost always
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one for a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="proofspark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for one run below the shared folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder's name there; raises ValueError where Arrow knows none."""
    if folder.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), posixpath.normpath(folder)
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    return store, root.rstrip("/") or "/"


_kept: list[str] | None = None
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def forget_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made since the last call, and note the coming ones.

    For drivers of several steps: once a step's result is stored, what it wrote on the way only fills the shared folder.
    Never called, nothing is noted or deleted.
    """
    global _kept
    for path in _kept or ():
        _delete(spark, path)
    _kept = []


def discard(spark: SparkSession, passing: list[str]) -> None:
    """Delete the tables in these folders and forget them; what was made of them must be stored by then."""
    for path in passing:
        _delete(spark, path)
        if _kept is not None and path in _kept:
            _kept.remove(path)
    passing.clear()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, batch: int | None = None, passing: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table into the shared folder and reading it back.

    ``batch``: rows that go to Python at a time while it is written, where the session's number is larger.
    ``passing``: gets the table's folder, for ``discard`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if passing is not None:
        passing.append(path)
    usual = spark.conf.get(BATCH)
    smaller = batch and not 0 < int(usual) <= batch
    try:
        if smaller:
            spark.conf.set(BATCH, str(batch))
        df.write.parquet(path)
    finally:
        if smaller:
            spark.conf.set(BATCH, usual)
    if _kept is not None:
        _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)
