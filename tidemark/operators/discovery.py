"""Discovery: keys found elsewhere, read page by page, become products or are given up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import first_per_key
from .merge import delete_keys, guarded_append, upsert_products


def pending_first(discovered: DataFrame, n: int = 50) -> DataFrame:
    """The n keys that wait longest, oldest first; ties by key."""
    return discovered.orderBy(F.asc_nulls_first("discovered_at"), "ext_key").limit(n)


def new_keys(found: DataFrame, known: DataFrame, n: int = 100) -> DataFrame:
    """``ext_key``: keys that no product has, at most n a run, in order of the key."""
    return delete_keys(found.select("ext_key").distinct(), known, "ext_key").orderBy("ext_key").limit(n)


def key_categories(items: DataFrame) -> DataFrame:
    """``ext_key, urls``: the category addresses under which each key was seen, sorted; keys seen under none are left out."""
    seen = items.where("source_category_url is not null and source_category_url <> ''").select("ext_key", "source_category_url")
    return seen.groupBy("ext_key").agg(F.sort_array(F.collect_set("source_category_url")).alias("urls"))


def run_counts(searches: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counters of a discovery run.

    ``searches`` has a row for each artist searched: ``artist, blocked, keys`` (an array, empty if nothing was found).
    ``processed`` are artists with finds, or without any though not blocked; ``empty`` the latter; of the distinct keys some
    are new and the others known already.
    """
    none = F.size("keys") <= 0
    artists = searches.agg(F.count_if(~none | ~F.col("blocked")).alias("processed"), F.count_if(none & ~F.col("blocked")).alias("empty"), F.count_if(F.col("blocked")).alias("blocked"))
    keys = searches.select(F.explode("keys").alias("ext_key")).distinct().join(known.select("ext_key", F.lit(1).alias("_known")).distinct(), "ext_key", "left")
    found = keys.agg(F.count("*").alias("found"), F.count_if(F.col("_known").isNull()).alias("new"), F.count_if(F.col("_known").isNotNull()).alias("known"))
    return artists.crossJoin(found)  # one row each


def run_counts_of(searches: DataFrame, finds: DataFrame, known: DataFrame) -> DataFrame:
    """The counters of run_counts from rows: ``artist, blocked`` of each search, ``artist, ext_key`` of each find; an artist's finds
    are counted in partial sums, never gathered."""
    numbers = finds.groupBy("artist").agg(F.count("*").alias("_n"))
    none = F.coalesce("_n", F.lit(0)) == 0
    artists = searches.join(numbers, "artist", "left").agg(F.count_if(~none | ~F.col("blocked")).alias("processed"), F.count_if(none & ~F.col("blocked")).alias("empty"), F.count_if(F.col("blocked")).alias("blocked"))
    keys = finds.select("ext_key").distinct().join(known.select("ext_key", F.lit(1).alias("_known")).distinct(), "ext_key", "left")
    return artists.crossJoin(keys.agg(F.count("*").alias("found"), F.count_if(F.col("_known").isNull()).alias("new"), F.count_if(F.col("_known").isNotNull()).alias("known")))  # one row each


def first_finder(finds: DataFrame, order: str) -> DataFrame:
    """Of a key that several artists' searches gave, the row of the first search."""
    return first_per_key(finds, ["ext_key"], F.asc_nulls_last(order), F.asc_nulls_last("artist_name"))


def intake(products: DataFrame, obs: DataFrame, discovered: DataFrame, processed: DataFrame, records: DataFrame, *, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Products, observations, waiting keys and one row of counts after a run over pending keys.

    ``processed`` are the keys whose pages were read, ``records`` what they gave (some gave none).  Records become products,
    with their price as an observation unless the product has an active deal; all processed keys leave the queue.
    """
    accepted = records.join(processed.select("ext_key").distinct(), "ext_key", "left_semi").withColumn("captured_at", F.lit(as_of).cast("timestamp"))
    merged = upsert_products(products, accepted, as_of=as_of, order=("captured_at", *sorted(set(records.columns) - {"ext_key", "captured_at"})))
    prices = accepted.join(merged.select("ext_key", F.col("id").alias("product_id")), "ext_key")
    merged, history = guarded_append(merged, obs, prices.withColumn("obs_id", F.xxhash64("ext_key", "captured_at")))
    counts = processed.select("ext_key").distinct().join(accepted.select("ext_key", F.lit(1).alias("_ok")).distinct(), "ext_key", "left").agg(F.count_if(F.col("_ok").isNotNull()).alias("accepted"), F.count_if(F.col("_ok").isNull()).alias("rejected"))
    return merged, history, delete_keys(discovered, processed, "ext_key"), counts
