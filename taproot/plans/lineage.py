"""Cutting lineage in a place that outlives executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where the session names none, a local master gets a temporary one; on a cluster that would be another disk on every
    machine, so there it is an error.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "taproot-checkpoints")


def _until_exit(spark: SparkSession, path: str) -> None:
    """Have a path deleted when the application ends."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that a lost executor costs nothing.

    For small results and those whose partitioning matters; :func:`stored` is smaller on disk.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        _until_exit(df.sparkSession, sc._jsc.sc().getCheckpointDir().get())
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns are read as needed, and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/taproot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs in here go as it ends, not when the driver happens to collect its garbage.

    For work of many queries, each of which is written or collected once.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
