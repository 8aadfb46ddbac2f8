"""Tables that are written once and read again, and broadcasts of a checked size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: list[str] = []
_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; remove_staged removes it.

    A local session without that setting gets one temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tideline-shared-"))
        root = _local[0]
    _folders.append(os.path.join(root, f"{name}-{uuid.uuid4().hex}"))
    return _folders[-1]


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, so that what reads it several times doesn't compute it again; survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> int:
    """Remove all folders given out so far; results that still read them must have been written. How many."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in _folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    n = len(_folders)
    _folders.clear()
    return n


def broadcast_if_small(df: DataFrame, most: int, name: str) -> DataFrame:
    """df staged, and marked for broadcast if it has at most `most` rows; beyond that, Spark joins it as it sees fit."""
    staged = stage(df, name)
    return F.broadcast(staged) if staged.limit(most + 1).count() <= most else staged
