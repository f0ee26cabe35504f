"""Price benchmarks of each product: one aggregation over one scan, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import above


def mean(price: Column, when: Column | None = None) -> Column:
    """Sum over count as doubles; sums of decimals are exact, so the result does not depend on the order of rows."""
    x = price if when is None else F.when(when, price)
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))


def benchmarks(obs: DataFrame, *, as_of: str, floor: float | None = 30, short_days: int = 30, long_days: int = 90, with_rest: bool = False) -> DataFrame:
    """``product_id, total_points, history_days, low_all_time, avg_all, avg_short_strict, avg_short, low_short, avg_long, current_price, latest_at``.

    Windows include their first moment.  ``avg_short`` falls back to the mean of all prices; averages have two decimals.
    The newest price comes from the same aggregation; ties in time go to the larger identifier, then the larger price.
    With ``with_rest`` prices below the floor are counted too: there is a row for each product that has any, and the columns
    ``price_count`` and ``latest_any`` are about all of its prices.
    """
    now = F.lit(as_of).cast("timestamp")
    inside = lambda days: F.col("captured_at") >= now - F.make_dt_interval(days=F.lit(days))
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    counts = F.col("price") >= floor if with_rest and floor is not None else F.lit(True)
    only = lambda x: F.when(counts, x) if with_rest and floor is not None else x
    price, time, row = only(F.col("price")), only(F.col("captured_at")), F.struct("captured_at", "obs_id", "price")
    span = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    days = F.greatest(F.lit(1), F.ceil(span / 86_400_000_000.0)).cast("int")
    rest = [F.count("*").alias("price_count"), F.max(row)["price"].cast("double").alias("latest_any")] if with_rest else []
    rows = (obs if with_rest else above(obs, floor)).groupBy("product_id").agg(
        F.count(price).alias("total_points"), F.when(F.count(time) > 0, days).alias("history_days"), F.min(price).cast("double").alias("low_all_time"),
        cents(mean(price)).alias("avg_all"), cents(mean(price, inside(short_days))).alias("avg_short_strict"),
        F.min(F.when(inside(short_days), price)).cast("double").alias("low_short"), cents(mean(price, inside(long_days))).alias("avg_long"), F.max(only(row)).alias("_newest"), *rest,
    )
    return rows.withColumn("avg_short", F.coalesce("avg_short_strict", "avg_all")).withColumn("current_price", F.col("_newest.price").cast("double")).withColumn("latest_at", F.col("_newest.captured_at")).drop("_newest")


def price_stats(obs: DataFrame, *, since: Column | None = None) -> DataFrame:
    """``product_id, points, latest, low, high, mean, low_at, high_at``: of ties the later row is taken."""
    rows = obs if since is None else obs.where(F.col("captured_at") >= since)
    key = F.struct("captured_at", "obs_id")
    return rows.groupBy("product_id").agg(
        F.count("*").alias("points"), F.max_by("price", F.struct("captured_at", "obs_id", "price")).cast("double").alias("latest"), F.min("price").cast("double").alias("low"),
        F.max("price").cast("double").alias("high"), mean(F.col("price")).alias("mean"),
        F.max_by("captured_at", F.struct(-F.col("price"), key)).alias("low_at"), F.max_by("captured_at", F.struct(F.col("price"), key)).alias("high_at"),
    )


def counter_backfill(products: DataFrame, obs: DataFrame) -> DataFrame:
    """Products with ``price_count`` counted anew, 0 where there is no observation."""
    counts = obs.groupBy(F.col("product_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    return products.drop("price_count").join(counts, "id", "left").withColumn("price_count", F.coalesce("_n", F.lit(0))).drop("_n")
