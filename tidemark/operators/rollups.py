"""Benchmarks kept by increments: partial aggregates that can be merged, by product and day.

A run aggregates its new observations only, into a row for each product and day and a row for each product.  Benchmarks are then the
sum of the products' rows (counts, sums, extremes, newest price), with windows from the days inside them: at most as many rows a product as
the longer window has days.  A day that a window's start cuts is taken from the observations of that day.  A batch is stored
under its name, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import parts_of

from .latest import above

#: A month's products and days are dealt over so many shares, so that the tasks of a month are several.
SHARES = 16
_SUMS = ["n", "total", "low", "first_at", "last_at", "newest"]
_SCHEMA = "n long, total decimal(38,2), low decimal(10,2), first_at timestamp, last_at timestamp, newest struct<captured_at:timestamp,obs_id:long,price:decimal(10,2)>"


def _month() -> Column:
    """The folder of a day, as ``yyyy-MM``."""
    return F.date_format("day", "yyyy-MM")


def _fresh() -> list[Column]:
    return [
        F.count("*").alias("n"), F.sum("price").cast("decimal(38,2)").alias("total"), F.min("price").cast("decimal(10,2)").alias("low"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"),
        F.max(F.struct("captured_at", F.col("obs_id").cast("long").alias("obs_id"), F.col("price").cast("decimal(10,2)").alias("price"))).alias("newest"),
    ]


def _merged() -> list[Column]:
    kind = {"n": F.sum, "total": F.sum, "low": F.min, "first_at": F.min, "last_at": F.max, "newest": F.max}
    return [f(c).cast("decimal(38,2)").alias(c) if c == "total" else f(c).alias(c) for c, f in kind.items()]


def _with_day(obs: DataFrame, floor: float | None) -> DataFrame:
    return above(obs, floor).select("product_id", F.to_date("captured_at").alias("day"), "captured_at", "obs_id", "price")


def daily(obs: DataFrame, *, floor: float | None = 30) -> DataFrame:
    """``product_id, day`` and the partial aggregates of the observations at or above the floor."""
    return _with_day(obs, floor).groupBy("product_id", "day").agg(*_fresh())


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial aggregates added up by the given keys."""
    return parts.groupBy(*keys).agg(*_merged())


def _write_days(rows: DataFrame, aggregates: list[Column], target: str) -> None:
    """Aggregates of ``product_id, day``, stored by month.

    Rows move once: a month's shares hold all rows of a group, in the order that grouping and writing by month need.
    """
    dealt = rows.withColumn("month", _month()).withColumn("_share", F.pmod(F.xxhash64("product_id", "day"), F.lit(SHARES))).repartition("month", "_share")
    dealt.groupBy("month", "_share", "product_id", "day").agg(*aggregates).drop("_share").write.mode("overwrite").partitionBy("month").parquet(target)


def add_batch(obs: DataFrame, folder: str, batch: str, *, floor: float | None = 30) -> None:
    """Store the partial aggregates of new observations under the name of their batch, days by month; a repeated batch replaces itself."""
    kind = obs.schema["product_id"].dataType.simpleString()
    _write_days(_with_day(obs, floor), _fresh(), f"{folder}/days/batch={batch}")
    stored = obs.sparkSession.read.schema(f"product_id {kind}, day date, {_SCHEMA}").parquet(f"{folder}/days/batch={batch}")  # an empty batch has no file
    merged(stored, "product_id").write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")


def read_batches(spark: SparkSession, folder: str, product_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """The stored days and totals of all batches; batches are still to be added up."""
    days = spark.read.schema(f"product_id {product_type}, day date, {_SCHEMA}, batch string, month string").parquet(f"{folder}/days")
    return days, spark.read.schema(f"product_id {product_type}, {_SCHEMA}, batch string").parquet(f"{folder}/totals")


def benchmarks_of(totals: DataFrame, days: DataFrame, *, as_of: str, short_days: int = 30, long_days: int = 90, observations: DataFrame | None = None, floor: float | None = 30) -> DataFrame:
    """The columns of ``benchmarks.benchmarks`` from stored totals and days.

    ``observations`` are needed where ``as_of`` is not midnight: those of the first day of each window, which it cuts, are
    read from there.  Days after ``as_of`` count, as they do in ``benchmarks``.
    """
    moment = datetime.datetime.fromisoformat(as_of)
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    starts = {"short": moment - datetime.timedelta(days=short_days), "long": moment - datetime.timedelta(days=long_days)}
    first = {k: s.date() if s.time() == datetime.time() else s.date() + datetime.timedelta(days=1) for k, s in starts.items()}
    rows = days.where(F.col("day") >= F.lit(min(first.values())))
    if "month" in days.columns:  # only these folders are read
        rows = rows.where(F.col("month") >= min(first.values()).strftime("%Y-%m"))
    inside = lambda c, kind: F.when(F.col("day") >= F.lit(first[kind]), F.col(c))
    parts = rows.select("product_id", *(inside(c, k).alias(f"{c}_{k}") for k in starts for c in ("n", "total", "low")))
    cut = [k for k, s in starts.items() if s.time() != datetime.time()]
    if cut and observations is None:
        raise ValueError("a window that starts within a day needs the observations of that day")
    for k in cut:
        stored = observations
        if "month" in stored.columns:  # only that day's folder is read
            stored = stored.where(F.col("month") == starts[k].strftime("%Y-%m"))
        of_day = above(stored, floor).where((F.col("captured_at") >= F.lit(str(starts[k])).cast("timestamp")) & (F.col("captured_at") < F.lit(str(first[k])).cast("timestamp")))
        own = {"n": F.lit(1).cast("long"), "total": F.col("price").cast("decimal(38,2)"), "low": F.col("price").cast("decimal(10,2)")}
        parts = parts.unionByName(of_day.select("product_id", *((own[c] if j == k else F.lit(None).cast({"n": "long", "total": "decimal(38,2)", "low": "decimal(10,2)"}[c])).alias(f"{c}_{j}") for j in starts for c in own)))
    windows = parts.groupBy("product_id").agg(*((F.min if c == "low" else F.sum)(f"{c}_{k}").alias(f"{c}_{k}") for k in starts for c in ("n", "total", "low")))
    mean = lambda total, n: cents(F.try_divide(F.col(total).cast("double"), F.col(n).cast("double")))
    span = F.unix_micros("last_at") - F.unix_micros("first_at")
    every = merged(totals, "product_id").join(windows, "product_id", "left")
    avg_all = mean("total", "n")
    return every.select(
        "product_id", F.col("n").alias("total_points"), F.greatest(F.lit(1), F.ceil(span / 86_400_000_000.0)).cast("int").alias("history_days"), F.col("low").cast("double").alias("low_all_time"), avg_all.alias("avg_all"),
        mean("total_short", "n_short").alias("avg_short_strict"), F.coalesce(mean("total_short", "n_short"), avg_all).alias("avg_short"), F.col("low_short").cast("double").alias("low_short"), mean("total_long", "n_long").alias("avg_long"),
        F.col("newest.price").cast("double").alias("current_price"), F.col("newest.captured_at").alias("latest_at"),
    )


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """All batches of a folder as one, in another folder.  A batch has one row for each group, so that a single one is written as it is."""
    days, totals = read_batches(spark, folder)
    if len(parts_of(spark, f"{folder}/days", "batch")) == 1:
        days.drop("batch").write.mode("overwrite").partitionBy("month").parquet(f"{target}/days/batch=all")
        totals.drop("batch").write.mode("overwrite").parquet(f"{target}/totals/batch=all")
        return
    _write_days(days.drop("month"), _merged(), f"{target}/days/batch=all")
    merged(totals, "product_id").write.mode("overwrite").parquet(f"{target}/totals/batch=all")
