"""Observations at rest: a table partitioned by month and batch, appended to and cut without being rewritten.

A batch writes its own partitions and, when it is repeated, replaces them and no others.  Retention drops the folders of months
that are over as a whole and rewrites the one month that the limit cuts.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import move, parts_of, remove, run_folder

COLUMNS = {"product_id": "long", "price": "decimal(10,2)", "captured_at": "timestamp", "obs_id": "long"}


def append_batch(obs: DataFrame, folder: str, batch: str) -> None:
    """Write a batch; the same batch written again counts once."""
    wanted = obs.select(*(F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()))
    rows = wanted.withColumn("month", F.date_format("captured_at", "yyyy-MM")).withColumn("batch", F.lit(batch))
    rows = rows.repartition("month").sortWithinPartitions("month", "product_id", "captured_at", "obs_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(folder)


def read_history(spark: SparkSession, folder: str, *, since: datetime.datetime | None = None) -> DataFrame:
    """The observations of all batches; with ``since`` only months from there on are read."""
    schema = ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())
    rows = spark.read.schema(f"{schema}, month string, batch string").parquet(folder)
    if since is not None:
        rows = rows.where((F.col("month") >= since.strftime("%Y-%m")) & (F.col("captured_at") >= F.lit(str(since)).cast("timestamp")))
    return rows


def retain_stored(spark: SparkSession, folder: str, *, as_of: str, days: int = 365) -> dict[str, int]:
    """Keep observations that are at most so many days old: ``dropped`` months go as folders, ``rewritten`` is one at most.

    The new folder of the month that is cut takes the place of the old one when it is complete.
    """
    limit = datetime.datetime.fromisoformat(as_of) - datetime.timedelta(days=days)
    edge, done = limit.strftime("%Y-%m"), {"dropped": 0, "rewritten": 0}
    for month in parts_of(spark, folder, "month"):
        if month < edge:
            remove(spark, f"{folder}/month={month}")
            done["dropped"] += 1
        elif month == edge:
            rows = read_history(spark, folder, since=limit).where(F.col("month") == month)
            staged = run_folder(spark, "month")
            rows.write.partitionBy("month", "batch").parquet(staged)
            remove(spark, f"{folder}/month={month}")
            if month in parts_of(spark, staged, "month"):
                move(spark, f"{staged}/month={month}", f"{folder}/month={month}")
            remove(spark, staged)
            done["rewritten"] += 1
    return done
