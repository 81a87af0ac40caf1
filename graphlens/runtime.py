"""Running on a cluster: shared folders, written cuts of a plan, checked broadcasts."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A table is broadcast by hint only when it has no more rows than this.
BROADCAST_ROWS = 200_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the Python workers import this package, wherever the driver found it: Spark
    sends it to each executor, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='graphlens-')}/graphlens-package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is configured, a fresh local one, but
    only if all executors are this machine's."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='graphlens-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends there, so a lost
    executor costs no rounds of a loop, and later plans see one version of the rows."""
    path = f"{shared_dir(df.sparkSession)}/graphlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets shuffles go that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
