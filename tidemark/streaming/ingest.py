"""Structured Streaming intake of observations (an extension: the batch operators need none of it)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, sf_dir: str, *, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, with ``ts`` as a timestamp, which event time needs."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    name = f"{sf_dir}/events.parquet"
    single = [f for f in static.inputFiles() if f.rstrip("/").endswith("/events.parquet")]
    stream = source.option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir) if single else source.parquet(name)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """``hour, n, low``: counts and lowest values of tumbling hours; later rows than the watermark allows are dropped in append mode."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("value").alias("low")).select(F.col("w.start").alias("hour"), "n", "low")


def distinct_observations(stream: DataFrame, key: str = "event_id", *, late: str = "1 day") -> DataFrame:
    """The first row of each key among those within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a snapshot operator (an upsert, say) on every micro-batch; batches repeat after a failure, so it must be idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str = "append", *, timeout: int = 600, folder: str | None = None) -> DataFrame:
    """Everything that is there now, written as a table: to ``folder``, or to one in spark.checkpoint.dir (local masters: a
    temporary one).  In complete mode each batch replaces the one before; a batch that is repeated is written once more to its
    own place, so nothing is counted twice."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    folder = folder or f"{shared or tempfile.mkdtemp(prefix='streams-')}/stream-{uuid.uuid4().hex}"
    target = lambda number: f"{folder}/table" + ("" if mode == "complete" else f"/batch={number}")
    write = lambda rows, number: rows.write.mode("overwrite").parquet(target(number))
    write(spark.createDataFrame([], stream.schema), -1)  # a table also where nothing came
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination(timeout)
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").select(stream.columns)
