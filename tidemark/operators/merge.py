"""Tables that change: each mutation is a function from the old snapshot and the changes to the new snapshot.

Joins are on the key of the table, so writing snapshots bucketed by it makes them local.  A key that comes twice in one batch
is reduced to its last row first, in an order the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import first_per_key

#: What becomes of a column when a row exists on both sides.
OVERWRITE, COALESCE_NEW, KEEP_OLD, LEAST, GREATEST = "overwrite", "coalesce_new", "keep_old", "least", "greatest"


def last_per_key(batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_per_key(batch, keys, *(F.desc_nulls_last(c) for c in order))


def merge(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str | Column], *, default: str = OVERWRITE, insert: bool = True) -> DataFrame:
    """The old table with the rows of new put in; both have unique keys and new has a subset of the columns.

    ``policy`` names a rule for a column, or gives an expression over ``old.column`` and ``new.column``; columns that only
    the old table has are kept.  Rows without a partner stay as they are or, with ``insert``, come in.
    """
    o = old.select(F.struct(*old.columns).alias("old"), *(F.col(k).alias(f"_o_{k}") for k in keys))
    n = new.select(F.struct(*new.columns).alias("new"), *(F.col(k).alias(f"_n_{k}") for k in keys))
    on = [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]
    rows = o.join(n, on, "full" if insert else "left")
    both, added = F.col("old").isNotNull() & F.col("new").isNotNull(), F.col("old").isNull()

    def column(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"old.{c}").alias(c)
        a, b, rule = F.col(f"old.{c}"), F.col(f"new.{c}"), policy.get(c, KEEP_OLD if c in keys else default)
        met = rule if isinstance(rule, Column) else {OVERWRITE: b, COALESCE_NEW: F.coalesce(b, a), KEEP_OLD: a, LEAST: F.least(a, b), GREATEST: F.greatest(a, b)}[rule]
        return F.when(both, met).when(added, b).otherwise(a).cast(old.schema[c].dataType).alias(c)

    return rows.select(*map(column, old.columns))


def upsert_products(products: DataFrame, records: DataFrame, *, as_of: str, order: tuple[str, ...] = ("captured_at",)) -> DataFrame:
    """Records by ``ext_key``: title, artist, image, address and rating are replaced, style and reviews only by known values;
    the slug and the time of creation stay; new products start available, without prices."""
    now = F.lit(as_of).cast("timestamp")
    new = last_per_key(records, ["ext_key"], *(c for c in order if c in records.columns))
    wanted = [c for c in new.columns if c in products.columns]
    new = new.select(*wanted).withColumn("updated_at", now).withColumn("last_crawled_at", now).withColumn("created_at", now)
    if "available" in products.columns and "available" not in wanted:
        new = new.withColumn("available", F.lit(True)).withColumn("price_count", F.lit(0))
    if "id" in products.columns and "id" not in wanted:
        new = new.withColumn("id", F.col("ext_key").cast(products.schema["id"].dataType))
    new = new.select(*(c for c in new.columns if c in products.columns))
    policy = {"style": COALESCE_NEW, "review_count": COALESCE_NEW} | dict.fromkeys(("slug", "created_at", "available", "price_count", "id"), KEEP_OLD)
    return merge(products, new, ["ext_key"], policy)


def guarded_append(products: DataFrame, obs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of products without an active deal are appended, and counted in ``price_count``; others are dropped."""
    open_ids = products.where("deal_score is null").select(F.col("id").alias("product_id"))
    accepted = incoming.join(open_ids, "product_id", "left_semi")
    return _counted(products, accepted), obs.unionByName(accepted.select(*obs.columns))


def append(products: DataFrame, obs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-check results: appended whatever the deal; the product becomes available, a known review count replaces the old."""
    seen = incoming.groupBy(F.col("product_id").alias("id")).agg(F.max("review_count").alias("_reviews") if "review_count" in incoming.columns else F.lit(None).cast("int").alias("_reviews"), F.lit(True).alias("_seen"))
    rows = _counted(products, incoming).join(seen, "id", "left")
    rows = rows.withColumn("available", F.col("available") | F.coalesce("_seen", F.lit(False))).withColumn("review_count", F.coalesce("_reviews", "review_count")).drop("_reviews", "_seen")
    return rows, obs.unionByName(incoming.select(*obs.columns))


def _counted(products: DataFrame, added: DataFrame) -> DataFrame:
    counts = added.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("_n"))
    rows = products.join(counts, "id", "left")
    return rows.withColumn("price_count", (F.col("price_count") + F.coalesce("_n", F.lit(0))).cast(products.schema["price_count"].dataType)).drop("_n")


def mark_unavailable(products: DataFrame, ids: DataFrame) -> DataFrame:
    """The products named in ``ids`` become unavailable and lose their deal."""
    rows = products.join(ids.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return rows.withColumn("available", F.col("available") & ~gone).withColumn("deal_score", F.when(~gone, F.col("deal_score"))).drop("_gone")


def update_identity(products: DataFrame, changes: DataFrame) -> DataFrame:
    """New identity columns (key, title, image, address, slug) by id; unknown ids change nothing."""
    return merge(products, changes, ["id"], {}, insert=False)


def delete_products(products: DataFrame, dependents: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Products by id, and their rows in dependent tables (by ``product_id``)."""
    keys = ids.select(F.col("id").alias("product_id")).distinct()
    return products.join(ids.select("id").distinct(), "id", "left_anti"), {k: v.join(keys, "product_id", "left_anti") for k, v in dependents.items()}


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def retain(obs: DataFrame, *, as_of: str, days: int = 365) -> DataFrame:
    """Observations not older than so many days; exactly so many is kept."""
    return obs.where(F.col("captured_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def insert_absent(df: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not there yet are added (of several the smallest by all columns); also one row of counts."""
    batch = first_per_key(rows, [key], *(F.asc_nulls_last(c) for c in rows.columns if c != key))
    fresh = batch.join(df.select(key).distinct(), key, "left_anti")
    counts = batch.join(df.select(key, F.lit(1).alias("_known")).distinct(), key, "left").agg(F.count_if(F.col("_known").isNull()).alias("new"), F.count_if(F.col("_known").isNotNull()).alias("known"))
    return df.unionByName(fresh.select(*df.columns)), counts


def upsert_links(links: DataFrame, pairs: DataFrame, products: DataFrame, categories: DataFrame, *, as_of: str) -> DataFrame:
    """Product-category links from (ext_key, url): the first time seen stays, the last becomes now; unknown ends are dropped."""
    now = F.lit(as_of).cast("timestamp")
    known = pairs.join(products.select("ext_key", F.col("id").alias("product_id")), "ext_key").join(categories.select("url", F.col("id").alias("category_id")), "url")
    new = known.select("product_id", "category_id").distinct().withColumn("first_seen_at", now).withColumn("last_seen_at", now)
    return merge(links, new, ["product_id", "category_id"], {"first_seen_at": LEAST, "last_seen_at": GREATEST})


def set_tags(products: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of all products of an artist, from unique (artist, tags)."""
    new = tags.select(F.col("artist").alias("_artist"), F.col("tags").alias("_tags"))
    return products.join(new, F.col("artist") == F.col("_artist"), "left").withColumn("tags", F.coalesce("_tags", "tags")).drop("_artist", "_tags")


def set_state(state: DataFrame, key: str, value: Column) -> DataFrame:
    """A key/value table with one value set."""
    row = state.sparkSession.range(1).select(F.lit(key).alias("key"), value.cast("string").alias("value"))
    return state.where(F.col("key") != key).unionByName(row)


def get_state(state: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One row with the ``value`` of a key, or the default where the table has none."""
    return state.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default).cast("string")).alias("value"))


def next_batch(index: Column, size: int = 13) -> Column:
    """The next index of a cycle."""
    return F.pmod(index + 1, F.lit(size))


def duplicate_slugs(products: DataFrame) -> DataFrame:
    """Slugs that several products have, with their number."""
    return products.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def drop_duplicates_of(changes: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variant keys found for products: those already tracked elsewhere mean a duplicate to delete, others a rename."""
    tracked = products.select(F.col("ext_key").alias("new_key"))
    return changes.join(tracked, "new_key", "left_semi"), changes.join(tracked, "new_key", "left_anti")
