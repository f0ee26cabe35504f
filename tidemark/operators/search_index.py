"""A stored search index: postings of weighted word positions, sorted by word.

A posting is a word of a product with its places: artist words weigh A and come first, title words weigh B and go on counting.
The table is range-partitioned and sorted by word, so that a prefix is a range of words that Parquet statistics narrow to a
few row groups.  A search reads the ranges of its prefixes in one scan and sums by product, so a word that a third of all
products has is no hot key.  Changed products are taken out by an anti-join and put in anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: What a place of class A to D weighs, and the limit of the sum of 1 / (i * i).
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LIMIT = 1.64493406685


def postings(products: DataFrame) -> DataFrame:
    """``token, id, places`` of columns ``id, artist, title``: a row for each distinct word of a product; places are structs
    ``pos, weight`` in their order.  Null and empty texts have no words."""
    artist, title = X.tokens(F.col("artist")), X.tokens(F.col("title"))
    placed = lambda words, weight, after: F.transform(words, lambda w, i: F.struct(w.alias("token"), (i + 1 + after).alias("pos"), F.lit(weight).alias("weight")))
    rows = products.select("id", F.concat(placed(artist, "A", F.lit(0)), placed(title, "B", F.size(artist))).alias("words"))
    rows = rows.select("id", "words", F.explode(F.array_distinct(F.transform("words", lambda w: w["token"]))).alias("token"))
    own = F.transform(F.filter("words", lambda w: w["token"] == F.col("token")), lambda w: F.struct(w["pos"].alias("pos"), w["weight"].alias("weight")))
    return rows.select("token", "id", own.alias("places"))


def write_index(index: DataFrame, folder: str, *, files: int | None = None) -> DataFrame:
    """The postings stored in the order of words; returns the stored table."""
    spread = index.repartitionByRange(files, "token", "id") if files else index.repartitionByRange("token", "id")
    spread.sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(folder)
    return read_index(index.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("token string, id long, places array<struct<pos:int,weight:string>>").parquet(folder)


def with_changes(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with products ``id, artist, title`` put in anew: their old postings go, their new ones come."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").select("token", "id", "places").unionByName(postings(changed))


def _within(prefix: str) -> Column:
    """The range of words that begin with a prefix."""
    return (F.col("token") >= prefix) & (F.col("token") < prefix[:-1] + chr(ord(prefix[-1]) + 1))


def matches(index: DataFrame, prefixes: list[str]) -> DataFrame:
    """``id, hits`` of products where each prefix begins a word: the structs ``token, places`` of all these words."""
    asked = sorted(set(prefixes))
    if not asked:
        return index.select("id", F.array(F.struct("token", "places")).alias("hits")).where(F.lit(False))
    one_of = _within(asked[0])
    for p in asked[1:]:
        one_of = one_of | _within(p)
    rows = index.where(one_of).groupBy("id").agg(F.collect_list(F.struct("token", "places")).alias("hits"), *(F.max(_within(p)).alias(f"_{i}") for i, p in enumerate(asked)))
    every = F.lit(True)
    for i in range(len(asked)):
        every = every & F.col(f"_{i}")
    return rows.where(every).select("id", F.array_sort("hits").alias("hits"))


def _weight(place: Column) -> Column:
    weight = F.lit(None).cast("double")
    for name, value in WEIGHTS.items():
        weight = F.when(place["weight"] == name, value).otherwise(weight)
    return weight


def _single(hits: Column) -> Column:
    """The rank of one prefix: for each word its heaviest place in full, the others damped by their number squared."""

    def word(hit: Column) -> Column:
        weights = F.transform(hit["places"], _weight)
        best = F.array_max(weights)
        damped = F.aggregate(F.transform(weights, lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda s, x: s + x)
        at = F.array_position(weights, best)
        return (best + damped - best / (at * at)) / LIMIT

    return F.aggregate(F.transform(hits, word), F.lit(0.0), lambda s, x: s + x)


def _near(distance: Column) -> Column:
    return F.when(distance > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def _together(hits: Column, prefixes: list[str]) -> Column:
    """The rank of several prefixes: each pair of their places counts by weight and distance, as independent evidence.

    Of an earlier prefix (in the order of words) the last of its words stands for all.
    """
    def of(prefix: str) -> Column:
        return F.filter(hits, lambda h: h["token"].startswith(prefix))

    def missed(places: Column, others: Column) -> Column:
        pair = lambda a, b: F.when(a["pos"] != b["pos"], 1 - F.sqrt(_weight(a) * _weight(b) * _near(F.abs(a["pos"] - b["pos"])))).otherwise(F.lit(1.0))
        each = F.flatten(F.transform(places, lambda a: F.transform(others, lambda b: pair(a, b))))
        return F.aggregate(each, F.lit(1.0), lambda s, x: s * x)

    miss = F.lit(1.0)
    for i, second in enumerate(prefixes):
        for first in prefixes[:i]:
            miss = miss * missed(F.flatten(F.transform(of(second), lambda h: h["places"])), F.element_at(of(first), -1)["places"])
    return 1 - miss


def text_rank(hits: Column, prefixes: list[str]) -> Column:
    """The rank that PostgreSQL publishes for weighted positions, of what ``matches`` returns."""
    asked = sorted(set(prefixes))
    return _together(hits, asked) if len(asked) > 1 else _single(hits)


def listed_by_index(products: DataFrame, index: DataFrame, search: str) -> DataFrame:
    """The products whose words the search's prefixes begin, found in the index; all of them for a search without words."""
    prefixes = X.search_prefixes(search)
    return products.join(matches(index, prefixes).select("id"), "id", "left_semi") if prefixes else products


def ranked_suggestions(products: DataFrame, index: DataFrame, term: str, *, n: int = 8, min_prices: int = 5) -> DataFrame:
    """Available products with enough prices for a beginning of a search of 2 to 100 characters, by rank, then by average price."""
    prefixes = X.search_prefixes(term) if 2 <= len(term.strip()) <= 100 else []
    found = matches(index, prefixes).select("id", text_rank(F.col("hits"), prefixes).alias("rank") if prefixes else F.lit(0.0).alias("rank"))
    rows = products.where(F.col("available") & (F.col("price_count") >= min_prices)).join(found, "id").withColumn("avg_price", F.col("avg_30d").cast("double"))
    return rows.orderBy(F.desc("rank"), F.desc_nulls_last("avg_price"), "id").limit(n).select("id", "title", "artist", "slug", "img_url", "avg_price", "rank")
