"""Tables stored for lookups: sorted by what is looked up, with its slugs as columns.

Products are range-partitioned and sorted by slug; artists' slugs, which are scattered then, get bloom filters.  A lookup is an
equality on a stored column, which the Parquet reader decides for most row groups without reading them, and no slug is
computed.  Observations are sorted by product and time, so that one product's history is one row group or two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: Bytes of a row group: small, so that few rows are read for one product.
ROW_GROUP = 4 << 20


def write_products(products: DataFrame, folder: str, *, files: int | None = None) -> DataFrame:
    """Products with ``slug``, ``artist_slug`` (names in order) and ``artist_slug_as_written`` (as they stand), stored for lookups."""
    rows = products.withColumn("artist_slug", X.artist_slug(F.col("artist"))).withColumn("artist_slug_as_written", X.slug(F.col("artist")))
    rows = rows.repartitionByRange(files, "slug") if files else rows.repartitionByRange("slug")
    writer = rows.sortWithinPartitions("slug").write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
    for c in ("slug", "artist_slug", "artist_slug_as_written"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "50000")
    writer.parquet(folder)
    return products.sparkSession.read.schema(rows.schema).parquet(folder)


def write_observations(obs: DataFrame, folder: str, *, files: int | None = None) -> DataFrame:
    """Observations sorted by product and time."""
    order = ["product_id", "captured_at", "obs_id"]
    rows = obs.repartitionByRange(files, *order) if files else obs.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return obs.sparkSession.read.schema(obs.schema).parquet(folder)


def by_slug(products: DataFrame, slug: str) -> DataFrame:
    """The stored product of a slug."""
    return products.where(F.col("slug") == slug)


def by_artist_slug(products: DataFrame, slug: str) -> DataFrame:
    """The stored products of an artist, whichever way round the name is written."""
    return products.where((F.col("artist_slug") == slug) | (F.col("artist_slug_as_written") == slug))


def history_of(obs: DataFrame, found: DataFrame) -> DataFrame:
    """The stored observations of a product that was looked up, a row or none: its identifier goes into the scan as a plain value."""
    row = found.select("id").first()
    return obs.where(F.col("product_id") == row["id"]) if row else obs.where(F.lit(False))


def read_generations(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """One table of files that were written under older layouts and newer ones: missing columns are null, narrower types widened,
    columns that the schema lacks left out.  Reading twice, or an already current file, changes nothing."""
    from .schemas import reconcile

    rows = None
    for folder in folders:
        part = reconcile(spark.read.parquet(folder), schema)
        part = part.select(*part.columns[: len(reconcile(spark.createDataFrame([], schema), schema).columns)])
        rows = part if rows is None else rows.unionByName(part)
    return rows if rows is not None else spark.createDataFrame([], schema)
