"""Tables at rest that change by key: only the buckets that a change touches are read and written.

Two layouts.  ``write_keyed`` puts rows into folders by a hash of the key, so that a mutation reads the folders of its keys and
replaces those, whatever the size of the table; deletions, upserts and updates by key are functions of these rows alone.
``save_bucketed`` stores a table in Spark's own buckets, sorted by key, for mutations that touch everything: joins on the key
then move the changes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import move, parts_of, remove, run_folder


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    rows.select("*", _bucket(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)


def write_keyed(rows: DataFrame, folder: str, key: str, *, buckets: int = 64) -> None:
    """Store a table by the hash of its key."""
    _write(rows, folder, key, buckets)


def read_keyed(spark: SparkSession, folder: str, schema: T.StructType, *, only: list[int] | None = None) -> DataFrame:
    """The stored table, or some of its buckets."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
    return (rows if only is None else rows.where(F.col("bucket").isin(only))).drop("bucket")


def change_keyed(spark: SparkSession, folder: str, schema: T.StructType, key: str, changes: DataFrame, mutate: Callable[[DataFrame, DataFrame], DataFrame], *, changes_key: str | None = None, buckets: int = 64) -> list[int]:
    """Apply a mutation (old rows, changes: new rows) to the buckets of the keys in ``changes``; returns their numbers.

    The mutation must leave rows of other keys as they are.  New buckets are written aside first and take the place of the
    old ones when all are complete, so a failure before that leaves the table as it was.
    """
    changes = changes.where(F.col(changes_key or key).isNotNull())
    touched = sorted(r["bucket"] for r in changes.select(_bucket(changes_key or key, buckets)).distinct().collect())  # as many as buckets at most
    if not touched:
        return []
    staged = run_folder(spark, "buckets")
    _write(mutate(read_keyed(spark, folder, schema, only=touched), changes).select(schema.names), staged, key, buckets)
    made = set(parts_of(spark, staged, "bucket"))
    for number in touched:
        remove(spark, f"{folder}/bucket={number}")
        if str(number) in made:
            move(spark, f"{staged}/bucket={number}", f"{folder}/bucket={number}")
    remove(spark, staged)
    return touched


def save_bucketed(rows: DataFrame, name: str, key: str, *, buckets: int = 64) -> DataFrame:
    """Store a table in buckets of its key, sorted; with at least as many buckets as shuffle partitions, joins leave it in place."""
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)
