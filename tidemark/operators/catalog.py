"""Catalogue queries: grid, artist page, style page, related products and tags, carousel, search, sitemap.

Filters on products run before prices are joined, top-k lists are ``orderBy().limit()`` with a total order, and price arrays are
gathered only for the products of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import pricing as P
from tidemark.functions import text as X

from .latest import first_per_key, latest_price, numbered, preferred_spelling, recent_prices

PAGE = 24


def sort_columns(sort: str) -> list[Column]:
    """The order of a sort mode, closed by the identifier; unknown modes are refused."""
    modes = {
        "desconto": [F.desc_nulls_last("discount")],
        "menor-preco": [F.asc_nulls_last("price")],
        "maior-preco": [F.desc_nulls_last("price")],
        "avaliados": [F.desc_nulls_last("rating"), F.desc_nulls_last("review_count")],
        "az": [F.asc_nulls_last("title")],
        "deals": [F.desc_nulls_last("deal_score"), F.desc_nulls_last("discount")],
    }
    if sort not in modes:
        raise ValueError(f"sort is one of {sorted(modes)}")
    return [*modes[sort], F.asc("id")]


def check_page(page: int) -> int:
    if page < 1:
        raise ValueError("pages start at 1")
    return page


def listed(products: DataFrame, *, search: str = "", artist: str | None = None, artists: list[str] | None = None, tag: str | None = None, min_prices: int = 5) -> DataFrame:
    """Available products with enough prices, narrowed by search words, artist or tag.

    A search whose words have letters or digits matches their beginnings in artist or title; any other is looked for as it is.
    """
    if len(search) > 200:
        raise ValueError("a search term has 200 characters at most")
    rows = products.where(F.col("available") & (F.col("price_count") >= min_prices))
    prefixes = X.search_prefixes(search)
    if prefixes:
        rows = rows.where(X.matches_all(F.concat(X.tokens(F.col("artist")), X.tokens(F.col("title"))), prefixes))
    elif search.strip():
        rows = rows.where(X.contains_text(F.col("title"), search.strip()) | X.contains_text(F.col("artist"), search.strip()))
    if artist is not None:
        rows = rows.where(F.col("artist") == artist)
    if artists is not None:
        rows = rows.where(F.col("artist").isin(artists))
    if tag is not None:
        rows = rows.where(F.array_contains(X.stored_tags(F.col("tags")), tag.lower()))
    return rows


def with_latest(products: DataFrame, obs: DataFrame, *, floor: float | None) -> DataFrame:
    """Products that have a price, with ``price, mean_price, discount``.

    The newest price is read from the observations, unless the products store it (``latest_any``, or ``latest_30`` for a floor
    of 30).
    """
    stored = "latest_any" if floor is None else f"latest_{floor:g}"
    if stored in products.columns:
        rows = products.where(F.col(stored).isNotNull()).withColumn("price", F.col(stored).cast("double"))
    else:
        rows = products.join(latest_price(obs, floor=floor).select(F.col("product_id").alias("id"), F.col("price").cast("double").alias("price")), "id")
    return rows.withColumn("mean_price", P.mean_or_latest(F.col("avg_30d"), F.col("price"))).withColumn("discount", P.discount(F.col("avg_30d"), F.col("price")))


def with_recent(page: DataFrame, obs: DataFrame, *, as_of: str, days: int, newest: bool, floor: float | None) -> DataFrame:
    """``recent`` prices of a page of products (a hundred at most); empty where the window has none.

    The page is kept in memory while it is used twice: for the observations of its products, and for the result.
    """
    page = page.persist()
    mine = obs.join(F.broadcast(page.select(F.col("id").alias("product_id"))), "product_id", "left_semi")  # a page
    recent = recent_prices(mine, as_of=as_of, days=days, newest=newest, floor=floor).withColumnRenamed("product_id", "id")
    return page.join(recent, "id", "left").withColumn("recent", F.coalesce("recent", F.expr("cast(array() as array<double>)")))


def with_badge(rows: DataFrame, *, as_of: str) -> DataFrame:
    """The score while fresh, and ``on_promotion``."""
    fresh = P.fresh_score(F.col("deal_score"), F.col("last_crawled_at"), F.lit(as_of).cast("timestamp"))
    return rows.withColumn("shown_score", fresh).withColumn("on_promotion", F.col("shown_score").isNotNull())


def _numbers_ok(rows: DataFrame) -> DataFrame:
    bad = F.isnan("price") | F.isnan("mean_price") | F.isnan("discount")
    return rows.where(~F.coalesce(bad, F.lit(False)))


def grid(products: DataFrame, obs: DataFrame, *, as_of: str, sort: str = "desconto", page: int = 1, search: str = "", artist: str | None = None, artists: list[str] | None = None, max_price: float | None = None, floor: float | None = 30, days: int = 30, size: int = PAGE) -> DataFrame:
    """A page of the catalogue, with ``place`` from 1."""
    rows = with_latest(listed(products, search=search, artist=artist, artists=artists), obs, floor=floor)
    rows = rows if max_price is None else rows.where(F.col("price") <= max_price)
    order = sort_columns(sort)
    top = rows.orderBy(*order).offset((check_page(page) - 1) * size).limit(size)
    return _numbers_ok(with_badge(with_recent(top, obs, as_of=as_of, days=days, newest=True, floor=floor), as_of=as_of)).orderBy(*order)


def grid_count(products: DataFrame, obs: DataFrame, *, mode: str = "listing", search: str = "", artist: str | None = None, max_price: float | None = None, floor: float | None = 30) -> DataFrame:
    """``total, pages``.  Mode "listing" counts products without looking at prices, unless a maximum is given; "exact" counts what the grid shows."""
    rows = listed(products, search=search, artist=artist)
    if mode == "exact" or max_price is not None:
        rows = with_latest(rows, obs, floor=floor)
        rows = rows if max_price is None else rows.where(F.col("price") <= max_price)
    return rows.agg(F.count("*").alias("total")).withColumn("pages", P.page_count(F.col("total")))


def artist_variants(products: DataFrame, slug: str) -> DataFrame:
    """``artist``: the spellings whose slug, in either order of names, is the one asked for."""
    name = F.col("artist")
    return products.select("artist").distinct().where((X.artist_slug(name) == slug) | (X.slug(name) == slug))


def artist_page(products: DataFrame, obs: DataFrame, slug: str, *, as_of: str, sort: str = "desconto", page: int = 1, max_price: float | None = None, days: int = 30) -> DataFrame:
    """The grid of all spellings of an artist; empty if there is none.  ``artist_name`` is the preferred spelling."""
    variants = artist_variants(products, slug)
    name = preferred_spelling(variants, F.lit(slug)).select(F.col("name").alias("artist_name"))
    own = products.join(F.broadcast(variants), "artist", "left_semi")  # spellings of one name
    return grid(own, obs, as_of=as_of, sort=sort, page=page, max_price=max_price, days=days).crossJoin(F.broadcast(name))  # one row


def tag_frequency(products: DataFrame, *, limit: int = 5, exclude: str | None = None, order: str = "id") -> DataFrame:
    """``tag, n``: the commonest tags, in lower case, without one name; of equal ones that which comes first in the order of a column."""
    rows = products.select(F.col(order).alias("_row"), F.posexplode(X.parse_tags(F.col("tags"))).alias("_at", "tag")).withColumn("tag", F.lower("tag"))
    rows = rows if exclude is None else rows.where(F.col("tag") != exclude.lower())
    counted = rows.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("_row", "_at")).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", "tag").limit(limit).select("tag", "n")


def detail_tags(tags: Column, artist: Column, limit: int = 5) -> Column:
    """The first tags of a product other than the artist's name."""
    return F.slice(F.filter(X.parse_tags(tags), lambda t: F.lower(t) != F.lower(artist)), 1, limit)


def tag_products(products: DataFrame) -> DataFrame:
    """``id, tag``: one row for each tag of an available product."""
    return products.where("available").select("id", F.explode(X.stored_tags(F.col("tags"))).alias("tag"))


def tag_counts(products: DataFrame) -> DataFrame:
    """``tag, total``: in how many products a tag is."""
    return tag_products(products).groupBy("tag").agg(F.count_distinct("id").alias("total"))


def related_tags(products: DataFrame, tag: str, *, limit: int = 10) -> DataFrame:
    """``tag, shared, total, jaccard``: tags whose sets of products resemble that of a tag most."""
    pairs = tag_products(products)
    current = pairs.where(F.col("tag") == tag.lower()).select("id").distinct()
    shared = pairs.join(current, "id", "left_semi").where(F.col("tag") != tag.lower()).groupBy("tag").agg(F.count_distinct("id").alias("shared"))
    size = current.agg(F.count("*").alias("size"))
    rows = shared.join(tag_counts(products), "tag").crossJoin(F.broadcast(size))  # one row
    return rows.withColumn("jaccard", F.col("shared") / (F.col("size") + F.col("total") - F.col("shared"))).orderBy(F.desc("jaccard"), "tag").limit(limit).select("tag", "shared", "total", "jaccard")


def style_slugs(products: DataFrame) -> DataFrame:
    """``slug, tag``: the smallest tag of each style slug."""
    rows = tag_products(products).select("tag").distinct().select(X.style_slug(F.col("tag")).alias("slug"), "tag")
    return rows.where("slug <> ''").groupBy("slug").agg(F.min("tag").alias("tag"))


def style_page(products: DataFrame, obs: DataFrame, tag: str, *, as_of: str, sort: str = "desconto", max_price: float | None = None, days: int = 30, cut: int = 96) -> DataFrame:
    """The ``cut`` best products of a tag by discount; maximum price and sorting come after the cut."""
    rows = with_latest(listed(products, tag=tag), obs, floor=None).withColumn("discount", P.discount_known(F.col("avg_30d"), F.col("price")))
    best = rows.orderBy(*sort_columns("desconto")).limit(cut)
    best = best if max_price is None else best.where(F.col("price") <= max_price)
    return with_badge(with_recent(best, obs, as_of=as_of, days=days, newest=False, floor=None), as_of=as_of).orderBy(*sort_columns(sort))


def style_page_of(products: DataFrame, obs: DataFrame, slug: str, **how) -> DataFrame:
    """The style page of a slug, with ``tag``: the slug stands for its smallest tag, which is looked up first; empty if unknown."""
    found = style_slugs(products).where(F.col("slug") == slug).select("tag").first()  # one row at most
    name = found["tag"] if found else ""
    return style_page(products if found else products.where(F.lit(False)), obs, name, **how).withColumn("tag", F.lit(name))


def portuguese_order(column: str) -> list[Column]:
    """The order of Portuguese, where accents and capitals come second; equal ones in binary order."""
    return [F.collate(F.col(column), "pt"), F.col(column)]


def in_portuguese_order(names: DataFrame, column: str) -> DataFrame:
    return names.orderBy(*portuguese_order(column))


def ping_styles(products: DataFrame) -> DataFrame:
    """``style``: of available products that have one, a row each."""
    return products.where(F.col("available") & F.col("style").isNotNull()).select("style")


def deals_to_check(products: DataFrame) -> DataFrame:
    """``place, ext_key, id, title`` of active deals: the best first, of equal ones the one updated longest ago."""
    rows = products.where("deal_score is not null").select("ext_key", "id", F.coalesce("title", F.lit("")).alias("title"), "deal_score", "updated_at")
    return numbered(rows, F.desc("deal_score"), F.asc_nulls_first("updated_at"), F.asc("id")).select("place", "ext_key", "id", "title")


def home_page(products: DataFrame, obs: DataFrame, top_slugs: DataFrame, *, as_of: str, search: str = "", artist: str | None = None, sort: str = "desconto", page: int = 1, max_price: float | None = None, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The grid, its count with the page shown and whether another can be appended, and the carousel, which is empty for a
    search or a single artist."""
    how = {"search": search, "artist": artist, "max_price": max_price}
    shown = grid(products, obs, as_of=as_of, sort=sort, page=page, days=days, **how)
    count = grid_count(products, obs, **how).withColumn("page", P.clamp_page(F.lit(page), F.col("pages"))).withColumn("has_more", P.has_more(F.lit(page), F.col("pages")))
    chosen = top_slugs.where(F.lit(not search.strip() and artist is None))
    return shown, count, carousel(products, obs, chosen, as_of=as_of, days=days)


def related_deals(products: DataFrame, obs: DataFrame, product_id, *, as_of: str, seed: int = 0, n: int = 4, days: int = 30) -> DataFrame:
    """Other products with a deal: the highest scores, equal ones in an order that the seed decides."""
    rows = listed(products).where((F.col("id") != product_id) & F.col("deal_score").isNotNull())
    top = rows.orderBy(F.desc("deal_score"), F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), "id").limit(n)
    return with_recent(with_latest(top, obs.join(top.select(F.col("id").alias("product_id")), "product_id", "left_semi"), floor=None), obs, as_of=as_of, days=days, newest=False, floor=None)


def carousel(products: DataFrame, obs: DataFrame, top_slugs: DataFrame, *, as_of: str, n: int = 40, days: int = 30) -> DataFrame:
    """The best deal of each artist of a chart (one spelling a slug, the smallest), best first."""
    names = products.where("available").select("artist").distinct().withColumn("slug", X.artist_slug(F.col("artist")))
    chosen = names.join(top_slugs.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.min("artist").alias("artist")).select("artist")
    rows = with_latest(listed(products).join(chosen, "artist", "left_semi"), obs, floor=None)
    best = first_per_key(rows, ["artist"], F.desc_nulls_last("deal_score"), P.discount_or_null(F.col("avg_30d"), F.col("price")).desc_nulls_last(), F.asc("id"))
    order = [F.desc_nulls_last("deal_score"), F.desc_nulls_last("discount"), F.asc("id")]
    return with_badge(with_recent(best.orderBy(*order).limit(n), obs, as_of=as_of, days=days, newest=True, floor=None), as_of=as_of).orderBy(*order)


def suggestions(products: DataFrame, term: str, *, n: int = 8) -> DataFrame:
    """Products for a beginning of a search, by rank; ``avg_price`` is the stored average.  Terms have 2 to 100 characters."""
    prefixes = X.search_prefixes(term) if 2 <= len(term.strip()) <= 100 else []
    rows = products.where("available")
    rows = rows.where(X.matches_all(F.concat(X.tokens(F.col("artist")), X.tokens(F.col("title"))), prefixes)) if prefixes else rows.where(F.lit(False))
    rows = rows.withColumn("rank", X.search_rank(F.col("artist"), F.col("title"), prefixes)).withColumn("avg_price", F.col("avg_30d").cast("double"))
    return rows.orderBy(F.desc("rank"), F.desc_nulls_last("avg_price"), "id").limit(n).select("id", "title", "artist", "slug", "img_url", "avg_price", "rank")


def sitemap(products: DataFrame, base: str = "https://example.com") -> DataFrame:
    """``kind, url``: addresses of available products, of artists and of styles, each slug once."""
    rows = products.where("available")
    part = lambda slugs, kind, path: slugs.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{base}/{path}/"), F.col("slug")).alias("url"))
    artists = rows.select(X.artist_slug(F.col("artist")).alias("slug")).where("slug <> ''").distinct()
    return part(rows.select("slug").distinct(), "product", "disco").unionByName(part(artists, "artist", "artista")).unionByName(part(style_slugs(products).select("slug"), "style", "estilo"))


def letter_buckets(products: DataFrame) -> DataFrame:
    """``letter, names``: artists (smallest spelling a slug) by first letter without accents; "#" for all else."""
    names = products.where("available").select("artist", X.artist_slug(F.col("artist")).alias("slug")).where("slug <> ''").groupBy("slug").agg(F.min("artist").alias("name"))
    first = F.upper(X.fold(F.left(F.col("name"), F.lit(1))))
    return names.withColumn("letter", F.when(first.rlike("^[A-Z]$"), first).otherwise("#")).groupBy("letter").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"), F.count("*").alias("n"))


def first_image(page: DataFrame, *order: Column) -> DataFrame:
    """``img_url``: of the first product of a page that has one."""
    return page.where("img_url is not null").orderBy(*order).limit(1).select("img_url")


def untagged_artists(products: DataFrame) -> DataFrame:
    """Artists whose tags were never fetched."""
    return products.where("tags is null and artist is not null").select("artist").distinct()


def stale_first(products: DataFrame, seen: DataFrame, *, as_of: str, n: int = 500) -> DataFrame:
    """Products to check again: not seen in this run, active deals first, then recent ones, the longest unchecked first."""
    recent = F.col("last_flagged_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(14))
    urgency = F.when(F.col("deal_score").isNotNull(), 0).when(F.coalesce(recent, F.lit(False)), 1).otherwise(2)
    rows = products.join(seen.select("ext_key").distinct(), "ext_key", "left_anti").withColumn("urgency", urgency)
    return rows.orderBy("urgency", F.asc_nulls_first("last_crawled_at"), "id").limit(n)


def detail(products: DataFrame, obs: DataFrame, slug: str, *, as_of: str, days: int = 365) -> DataFrame:
    """The product of a slug with its history of a year, in order of time; no row for an unknown slug."""
    own = products.where(F.col("slug") == slug)
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    rows = obs.where(F.col("captured_at") >= since).join(own.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    history = rows.groupBy(F.col("product_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("captured_at", "obs_id", "price"))).alias("history"))
    return own.join(history, "id", "left")


def detail_page(products: DataFrame, obs: DataFrame, slug: str, *, as_of: str, days: int = 365, zone: str = "America/Sao_Paulo") -> DataFrame:
    """The product of a slug with the figures of its page, from one history of a year: points, latest, lowest, highest and mean
    price, when the lowest and highest were seen last, status, and the history with the change to the price before and local
    labels.  No row for an unknown slug; a product without history has null figures and an empty history."""
    now = F.lit(as_of).cast("timestamp")
    own = detail(products, obs, slug, as_of=as_of, days=days)
    points = F.coalesce("history", F.array().cast("array<struct<captured_at:timestamp,obs_id:bigint,price:decimal(10,2)>>"))
    price = F.transform(points, lambda x: x["price"].cast("double"))
    mean = F.aggregate(points, F.lit(0).cast("decimal(20,2)"), lambda s, x: (s + x["price"]).cast("decimal(20,2)"), lambda s: s.cast("double")) / F.nullif(F.size(points), F.lit(0))
    last = lambda best: F.array_max(F.transform(F.filter(points, lambda x: x["price"].cast("double") == best), lambda x: x["captured_at"]))
    row = lambda x, i: F.struct(
        x["captured_at"].alias("captured_at"), x["price"].cast("double").alias("price"), (x["price"].cast("double") - F.get(points, i - 1)["price"].cast("double")).alias("delta"),
        P.day_label(x["captured_at"], now, zone).alias("label"), P.full_label(x["captured_at"], zone).alias("full_label"),
    )
    low, high, latest = F.array_min(price), F.array_max(price), F.get(price, F.size(price) - 1)
    return own.withColumn("points", F.size(points)).withColumn("latest", latest).withColumn("low", low).withColumn("high", high).withColumn("mean", mean).withColumn("low_at", last(low)).withColumn("high_at", last(high)).withColumn(
        "status", P.price_status(latest, low, mean, F.size(points))
    ).withColumn("first_tags", detail_tags(F.col("tags"), F.col("artist"))).withColumn("history", F.transform(points, row))


def enrich_tags(products: DataFrame, payloads: DataFrame, tags_of: Column) -> DataFrame:
    """Products with the tags of artists that never had any fetched: ``payloads`` has ``artist`` and what ``tags_of`` reads.

    An artist without labels gets an empty text, which means fetched; artists without payload stay as they are.
    """
    wanted = payloads.join(untagged_artists(products), "artist", "left_semi")
    return set_tags_where_null(products, wanted.select("artist", F.array_join(tags_of, ", ").alias("tags")))


def set_tags_where_null(products: DataFrame, tags: DataFrame) -> DataFrame:
    new = tags.groupBy(F.col("artist").alias("_artist")).agg(F.min("tags").alias("_tags"))
    return products.join(new, F.col("artist") == F.col("_artist"), "left").withColumn("tags", F.coalesce("tags", "_tags")).drop("_artist", "_tags")


def list_json(rows: DataFrame, name: str, base: str, *order: Column) -> DataFrame:
    """One row ``json``: a schema.org list of a page's products, in the given order."""
    placed = rows.withColumn("_place", F.row_number().over(W.orderBy(*order)))  # one page
    item = F.struct(F.lit("ListItem").alias("@type"), F.col("_place").alias("position"), F.concat(F.lit(f"{base}/disco/"), F.col("slug")).alias("url"), F.col("title").alias("name"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("_place", item.alias("item")))), lambda x: x["item"])
    head = [F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.lit(name).alias("name")]
    return placed.agg(F.to_json(F.struct(*head, F.count("*").alias("numberOfItems"), items.alias("itemListElement"))).alias("json"))


def breadcrumb_json(steps: list[tuple[str | Column, str | Column]]) -> Column:
    """A schema.org trail of (name, address), each a text or a column."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    item = lambda k, name, url: F.struct(F.lit("ListItem").alias("@type"), F.lit(k).alias("position"), lit(name).alias("name"), lit(url).alias("item"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.array(*(item(k, *s) for k, s in enumerate(steps, 1))).alias("itemListElement")))


def product_json(rows: DataFrame) -> DataFrame:
    """``id, json``: a schema.org description of products with a price."""
    offer = F.struct(F.lit("Offer").alias("@type"), F.lit("BRL").alias("priceCurrency"), F.col("price"), F.when(F.col("available"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"))
    return rows.select("id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("title").alias("name"), F.struct(F.lit("Brand").alias("@type"), F.col("artist").alias("name")).alias("brand"), offer.alias("offers"))).alias("json"))


def related_tags_of_all(products: DataFrame, *, limit: int = 10) -> DataFrame:
    """``tag, related, shared, total, jaccard, place``: what related_tags finds, for every tag at once.

    Tags meet inside their product, whose tags are few; pairs are counted before the shuffle, so that a tag that most
    products have is no hot key, and the best are cut in each task before the rest moves.
    """
    tags = products.where("available").select(F.array_distinct(X.stored_tags(F.col("tags"))).alias("tags"))
    totals = tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("total"))
    met = tags.select(F.explode("tags").alias("tag"), "tags").select("tag", F.explode("tags").alias("related")).where("tag <> related")
    shared = met.groupBy("tag", "related").agg(F.count("*").alias("shared"))
    rows = shared.join(totals.withColumnRenamed("total", "_own"), "tag").join(totals.withColumnRenamed("tag", "related"), "related")
    rows = rows.withColumn("jaccard", F.col("shared") / (F.col("_own") + F.col("total") - F.col("shared")))
    place = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("jaccard"), "related"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("tag", "related", "shared", "total", "jaccard", "place")
