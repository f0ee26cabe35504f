"""JSON payloads at rest: chart pages and tag lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Labels that say nothing about a genre.
NON_GENRE = (
    "seen live", "beautiful", "favourite", "my favourite", "my favorites", "favorite", "favorites", "love", "awesome", "best", "amazing", "great",
    "perfect", "legend", "legends", "excellent", "loved", "buy", "under review", "spotify", "youtube", "all", "albums i own", "artists i've seen live",
    "guitar", "bass", "drums", "vocals", "instrumental", "piano", "keyboards", "male vocalists", "female vocalists",
    "american", "british", "german", "french", "swedish", "english", "scottish", "canadian", "australian", "norwegian", "brazilian", "japanese", "korean",
    "italian", "spanish", "portuguese", "irish", "danish", "finnish", "classic", "classics", "oldies", "retro", "vintage",
)


def chart_names(pages: DataFrame, *, payload: str = "payload", page: str = "page") -> DataFrame:
    """``name, rank``: distinct names of chart pages, each at its best rank (1 is the first of page 1, pages are full)."""
    parsed = F.from_json(payload, "artists struct<artist:array<struct<name:string>>>")
    rows = pages.select(F.col(page).alias("_page"), parsed["artists"]["artist"]["name"].alias("_names"))
    full = F.size("_names")
    ranked = rows.select("_page", full.alias("_n"), F.posexplode("_names").alias("_at", "name")).where("name is not null")
    return ranked.groupBy("name").agg(F.min((F.col("_page") - 1) * F.col("_n") + F.col("_at") + 1).alias("rank"))


def chart_slugs(pages: DataFrame, **columns: str) -> DataFrame:
    """``slug``: the distinct artist slugs of chart pages."""
    return chart_names(pages, **columns).select(X.artist_slug(F.col("name")).alias("slug")).where("slug <> ''").distinct()


def chart_slice(names: DataFrame, first: int, last: int) -> DataFrame:
    """The names whose rank lies in first to last, inclusive."""
    return names.where(F.col("rank").between(first, last))


def genre_tags(payload: Column, max_tags: int = 3) -> Column:
    """The first labels of a tag payload that may be genres: 2 to 40 characters, not in the stop list.  Errors and bad JSON give none."""
    parsed = F.from_json(payload, "error int, toptags struct<tag:array<struct<name:string>>>")
    labels = F.transform(parsed["toptags"]["tag"]["name"], lambda x: F.trim(F.lower(x)))
    good = F.filter(labels, lambda x: F.length(x).between(2, 40) & ~x.isin(*NON_GENRE))
    return F.when(parsed["error"].isNull() & good.isNotNull(), F.slice(good, 1, max_tags)).otherwise(F.expr("cast(array() as array<string>)"))


def category_seed(lists: DataFrame) -> DataFrame:
    """``name, url`` of categories given as two lists of equal length, ``names`` and ``urls``; lists of other lengths are refused."""
    zipped = F.when(F.size("names") == F.size("urls"), F.arrays_zip("names", "urls")).otherwise(F.raise_error(F.lit("names and urls differ in number")))
    return lists.select(F.explode(zipped).alias("x")).select(F.col("x.names").alias("name"), F.col("x.urls").alias("url"))
