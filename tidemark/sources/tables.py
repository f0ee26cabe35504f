"""Readers, and adapters that present the star-schema tables as products and price observations.

Adapter A (long history) takes parts as products and line items as observations; adapter B (dense) takes users and event values.
The adapters only rename and derive columns, so filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.benchmarks import benchmarks


@dataclass(frozen=True)
class Domain:
    """A point in time and the two windows, in days."""

    as_of: str
    short_days: int
    long_days: int


LONG = Domain("2001-11-05 00:00:00", 365, 1095)
DENSE = Domain("2024-01-31 00:00:00", 7, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: ``product_id, price, captured_at, obs_id``."""
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).cast("decimal(10,2)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), price.alias("price"), F.col("l_shipdate").cast("timestamp").alias("captured_at"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"))


def dense_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("product_id"), F.col("value").cast("decimal(10,2)").alias("price"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("event_id").alias("obs_id"))


def products(spark: SparkSession, sf_dir: str, *, with_benchmarks: bool = True) -> DataFrame:
    """Adapter A's products; the previous scoring state is derived from the identifiers.

    The columns that a catalogue stores with its products (counts, averages, newest prices) come from one aggregation.
    """
    k = F.col("p_partkey")
    hours = lambda n: at(LONG.as_of) - F.make_dt_interval(hours=n.cast("int"))
    artist = F.when(k % 4 == 3, F.concat(F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit(", BRAND"))).otherwise(F.col("p_brand"))
    key = F.concat(F.lit("K"), F.lpad(k.cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), key.alias("ext_key"), F.col("p_name").alias("title"), artist.alias("artist"), F.lower("p_type").alias("style"),
        X.product_slug(F.col("p_name"), key).alias("slug"), F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", "), F.lower("p_type")).alias("tags"),
        F.when(k % 5 != 0, F.concat(F.lit("https://img.example.com/"), key)).alias("img_url"), F.when(k % 9 != 0, (k % 51) / 10.0).alias("rating"), F.when(k % 7 != 0, k % 997).alias("review_count"),
        (k % 11 != 0).alias("available"), F.when(k % 7 < 3, k % 3 + 1).alias("deal_score"), F.when(k % 7 < 4, hours(k % 12)).alias("last_flagged_at"),
        F.when(k % 7 < 4, F.col("p_retailprice").cast("decimal(10,2)")).alias("last_flagged_price"), hours(k % 10).alias("last_crawled_at"),
    )
    if not with_benchmarks:
        return rows
    stats = benchmarks(observations(spark, sf_dir), as_of=LONG.as_of, floor=30, short_days=LONG.short_days, long_days=LONG.long_days, with_rest=True)
    stats = stats.select(F.col("product_id").alias("id"), "price_count", F.col("avg_short").alias("avg_30d"), "low_all_time", "history_days", "latest_any", F.col("current_price").alias("latest_30"))
    return rows.join(stats, "id", "left").withColumn("price_count", F.coalesce("price_count", F.lit(0)))
