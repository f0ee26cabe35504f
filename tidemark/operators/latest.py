"""Latest row per key, recent values, first sightings, changes.

Every order is made total by the caller's keys, and null places are explicit.  ``row_number() <= n`` gets a partial limit
before the shuffle, so hot keys send at most n rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import run_folder

NEWEST = ("captured_at", "obs_id", "price")


def first_per_key(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, in an order of the whole table, which should be total.

    Rows are range-sorted and written out; a row's place is its place in its part and the sizes of the parts before,
    so that no task gets more than its part.
    """
    spark, folder = df.sparkSession, run_folder(df.sparkSession, "numbered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each part
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def above(obs: DataFrame, floor: float | None) -> DataFrame:
    return obs if floor is None else obs.where(F.col("price") >= floor)


def latest_price(obs: DataFrame, *, floor: float | None = None, until: Column | None = None) -> DataFrame:
    """``product_id, price, captured_at``: the newest observation of each product (at or above the floor, up to a time)."""
    rows = above(obs, floor)
    rows = rows if until is None else rows.where(F.col("captured_at") <= until)
    return first_per_key(rows, ["product_id"], *(F.desc_nulls_last(c) for c in NEWEST)).select("product_id", "price", "captured_at")


def recent_prices(obs: DataFrame, *, as_of: str, days: int = 30, n: int = 10, newest: bool = True, floor: float | None = None) -> DataFrame:
    """``product_id, recent``: up to n prices of the window in order of time; the newest n, or else the oldest n."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    order = [F.desc_nulls_last(c) if newest else F.asc_nulls_last(c) for c in NEWEST]
    rows = first_per_key(above(obs, floor).where(F.col("captured_at") >= since), ["product_id"], *order, n=n)
    ordered = F.sort_array(F.collect_list(F.struct("captured_at", "obs_id", F.col("price").cast("double").alias("price"))))
    return rows.groupBy("product_id").agg(F.transform(ordered, lambda x: x["price"]).alias("recent"))


def first_sighting(sources: list[DataFrame], key: str, *order: str) -> DataFrame:
    """The union of sources by name; of rows with one key the one from the earliest source, then in the given order."""
    rows = None
    for rank, source in enumerate(sources):
        source = source.withColumn("_rank", F.lit(rank))
        rows = source if rows is None else rows.unionByName(source, allowMissingColumns=True)
    return first_per_key(rows, [key], F.asc("_rank"), *(F.asc_nulls_last(c) for c in order)).drop("_rank")


def price_changes(obs: DataFrame) -> DataFrame:
    """Adds ``previous, delta``: against the observation before in time."""
    order = W.partitionBy("product_id").orderBy(*(F.asc_nulls_last(c) for c in NEWEST))
    return obs.withColumn("previous", F.lag("price").over(order)).withColumn("delta", F.col("price") - F.col("previous"))


def rolling_mean(obs: DataFrame, days: int) -> DataFrame:
    """Adds ``rolling``: the mean of the prices of the last days before each observation, itself included."""
    span = W.partitionBy("product_id").orderBy(F.unix_micros("captured_at")).rangeBetween(-days * 86_400_000_000, 0)
    return obs.withColumn("rolling", F.sum("price").over(span).cast("double") / F.count("price").over(span))


def preferred_spelling(names: DataFrame, slug: Column, name: str = "artist") -> DataFrame:
    """``slug, name``: of the spellings of a slug, one without comma, not all capitals, then the shortest."""
    rows = names.select(F.col(name).alias("name"), slug.alias("slug")).where("slug <> '' and name is not null").distinct()
    capitals = (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))
    return first_per_key(rows, ["slug"], F.col("name").contains(",").cast("int") + capitals.cast("int"), F.length("name"), F.col("name")).select("slug", "name")
