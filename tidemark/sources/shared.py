"""Folders for tables at rest, in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset a local master gets a temporary one, a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tables-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def parts_of(spark: SparkSession, folder: str, key: str) -> list[str]:
    """The values of the first partition column of a stored table, from the names of its folders alone."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}="))


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _files(spark, folder)
    fs.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, path = _files(spark, source)
    if not fs.rename(path, _files(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")
