"""Intermediate tables in the folder the cluster shares for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Folder of each local application that has no checkpoint folder of its own.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder,
    which goes when the process ends."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        folder = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="askorpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL[context.applicationId]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later uses do not repeat the work or its Python stages.

    A Parquet table rather than a cached one, so it survives lost executors and
    each later use reads only the columns it needs. Its size on disk also lets
    the optimiser choose between broadcasting and shuffling it.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged. Call it when no frame built here is
    needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
