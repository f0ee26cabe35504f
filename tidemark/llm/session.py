"""Where intermediate results go: the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many identifiers (some tens of MB in a task) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset a local master gets a temporary folder, as in tests; on a cluster that is an error, since executors
    could not read what others wrote.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_or_shuffled(ids: DataFrame, limit: int | None = None) -> DataFrame:
    """A table of identifiers, written out and counted: broadcast in joins if it is small, so that texts need not move."""
    shared_folder(ids.sparkSession)
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if limit is None else limit) else ids
