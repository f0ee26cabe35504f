"""Queries over synthetic shop pages made from the parts, and over whole pages of the catalogue; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pricing as P
from tidemark.functions import text as X
from tidemark.operators import catalog as C
from tidemark.operators import discovery as D
from tidemark.operators import html as H
from tidemark.operators import latest as L
from tidemark.operators import merge as M
from tidemark.operators import notify as N
from tidemark.operators import scoring as S
from tidemark.sources import payloads
from tidemark.sources import tables as T
from tidemark.sources.shared import run_folder

from .catalogue import _CHART, _FRESH, _GRID_COLUMNS, _LISTED, _MOVED, _ORDERS, _QUEUE, DAYS, NOW, SQL, _chart, _grid_sql, _queue, cents, moved, query, seconds
from .tables_sql import BASE, LONG_AS_OF, OBS, artist_slug, latest_any, recent, slug

# --- listing pages ---------------------------------------------------------------------------------------------------


def _key(k: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0"))


def _money(v: Column) -> Column:
    return F.concat(F.lit("R$ "), X.brl(v))


def _span(cls: str, body: Column, more: str = "") -> Column:
    return F.concat(F.lit(f'<span class="{cls}"{more}>'), body, F.lit("</span>"))


def _price(body: Column, cls: str = "a-price", more: str = ' data-a-color="base"') -> Column:
    return _span(cls, _span("a-offscreen", body), more)


def _card(kind: Column) -> Column:
    """A card of a listing page; the kinds, 0 to 11, differ in where things stand and in what is missing."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    title = F.when(kind == 8, F.concat("p_name", F.lit(" CD set"))).otherwise(F.col("p_name"))
    head = F.when(kind == 5, F.concat(F.lit('<h2><a class="a-link-normal"><span class="a-text-normal">4,5 de 5 estrelas</span></a><a><span class="a-text-normal">x</span></a></h2><div class="s-title-instructions-style"><span>'), title, F.lit("</span></div>")))
    head = head.when(kind == 11, F.lit("<h2><a><span>R$ 12</span></a></h2>")).otherwise(F.concat(F.lit("<h2><a><span>"), title, F.lit("</span></a></h2>")))
    artist = F.when(kind == 6, F.lit("")).otherwise(F.concat(F.lit('<div class="a-row"><span class="a-color-secondary"><span class="a-size-base">por '), F.col("p_brand"), F.lit("</span></span></div>")))
    whole, cent = F.floor(price).cast("long"), F.lpad(F.floor((price - F.floor(price)) * 100 + 0.5).cast("int").cast("string"), 2, "0")
    parts = F.concat(F.lit('<span class="a-price" data-a-color="base"><span class="a-price-whole">'), F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit('<span class="a-price-decimal">,</span></span><span class="a-price-fraction">'), cent, F.lit("</span></span>"))
    plain = _price(_money(price))
    shown = F.when(kind == 1, parts)
    shown = shown.when(kind == 2, F.concat(_price(_money(price + 500), "a-price a-text-price"), F.lit('<div><div><span>em até 10x de </span>'), _price(_money(price / 10 + 100)), F.lit("</div></div></div><div><div><div><div>"), plain, F.lit("</div></div></div>")))
    shown = shown.when(kind == 3, F.concat(F.lit('<div data-cy="secondary-offer-recipe">'), _price(_money(price + 700)), F.lit("</div>"), plain))
    shown = shown.when(kind == 9, _price(F.lit("R$ 9,90"))).when(kind == 10, F.concat(F.lit('<div data-cy="price-recipe">'), _price(_money(price), "a-price", ' data-a-size="xl" data-a-color="base"'), F.lit("</div>"), _price(_money(price + 900)))).otherwise(plain)
    image = F.when(kind == 4, F.concat(F.lit('<img class="s-image" src="data:x" srcset="https://i/a'), k, F.lit("._AC_UL160_.jpg 1x, https://i/b"), k, F.lit('._AC_UL320_.jpg 2x">'))).otherwise(F.concat(F.lit('<img class="s-image" src="https://i/p'), k, F.lit('._AC_UL320_.jpg">')))
    stars = F.concat(F.lit('<span aria-label="'), F.translate((k % 51 / 10).cast("string"), ".", ","), F.lit(' de 5 estrelas"></span><span aria-label="'), F.translate(F.format_number(k * 7 % 9000, 0), ",", "."), F.lit(' classificações"></span>'))
    key = F.when(kind == 7, F.lit("")).otherwise(_key(k))
    return F.concat(F.lit('<div data-component-type="s-search-result" data-asin="'), key, F.lit('">'), head, artist, stars, image, F.lit('<div class="a-section"><div><div><div>'), shown, F.lit("</div></div></div></div></div>"))


def listing_pages(spark, d) -> DataFrame:
    """``page, html``: 20 cards a page."""
    kind = F.col("p_partkey") % 12
    cards = T.table(spark, d, "part").select((F.floor(F.col("p_partkey") / 20)).alias("page"), "p_partkey", _card(kind).alias("card"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "\n")
    return cards.groupBy("page").agg(F.concat(F.lit("<html><body>"), joined, F.when(F.col("page") % 2 == 0, '<a class="s-pagination-item s-pagination-next" href="#">Next</a>').otherwise(""), F.lit("</body></html>")).alias("html"))


_ARTIST = "CASE WHEN p_partkey % 12 = 6 THEN 'Artista não identificado' ELSE p_brand END"


@query("html_listing", f"""SELECT p_partkey // 20 AS page, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_name AS title, {_ARTIST} AS artist, p_retailprice AS price,
  CAST(p_partkey % 51 AS DOUBLE) / 10 AS rating, CASE WHEN p_partkey * 7 % 9000 > 0 THEN CAST(p_partkey * 7 % 9000 AS INTEGER) END AS review_count,
  'https://i/' || CASE WHEN p_partkey % 12 = 4 THEN 'b' ELSE 'p' END || p_partkey || '._AC_SX300_.jpg' AS image, {slug("left(p_name, 80)")} || '-' || right(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 6) AS slug
  FROM part WHERE p_partkey % 12 NOT IN (7, 8, 9, 11)""")
def html_listing(spark, d):
    return H.listing_records(listing_pages(spark, d)).select("page", "ext_key", "title", "artist", F.round("price", 2).alias("price"), "rating", "review_count", "image", "slug")


@query("html_skips", "SELECT CASE p_partkey % 12 WHEN 7 THEN 'no_key' WHEN 8 THEN 'not_vinyl' WHEN 9 THEN 'no_price' ELSE 'no_title' END AS reason, count(*) AS n FROM part WHERE p_partkey % 12 IN (7, 8, 9, 11) GROUP BY 1")
def html_skips(spark, d):
    return H.skip_counts(listing_pages(spark, d))


@query("html_next_page", "SELECT DISTINCT p_partkey // 20 AS page, true AS has_next FROM part UNION ALL SELECT -1, false")
def html_next_page(spark, d):
    pages = listing_pages(spark, d).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("page"), F.lit("<p>nothing</p>").alias("html")))
    return H.has_next(pages).select("page", "has_next")


@query("html_attribute_keys", "SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key FROM part WHERE p_partkey % 12 <> 7 UNION SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier")
def html_attribute_keys(spark, d):
    scripts = T.table(spark, d, "supplier").select(F.concat(F.lit('<script>{"asin" : "s'), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit('"}</script>')).alias("html"))
    return H.mined_keys(listing_pages(spark, d).select("html").unionByName(scripts))


# --- product pages ---------------------------------------------------------------------------------------------------


def product_pages(spark, d) -> DataFrame:
    """``ext_key, html``: a page for each part, of eight kinds."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    kind = k % 9
    pay = F.concat(F.lit('<div class="priceToPay"><span class="a-offscreen">'), _money(price), F.lit("</span></div>"))
    swatch = lambda chosen, vinyl: F.concat(F.lit('<div id="tmmSwatches"><div class="swatchElement'), F.lit(" selected" if chosen else ""), F.lit('">CD</div>'), vinyl, F.lit("</div>"))
    vinyl = F.concat(F.lit('<div class="swatchElement">Vinil <a href="/dp/v'), F.lpad(k.cast("string"), 9, "0"), F.lit('/ref">v</a><span aria-label="'), _money(price + 60), F.lit('"></span></div>'))
    body = F.when(kind == 0, F.concat(F.lit('<div id="availability">Em estoque</div>'), pay)).when(kind == 1, F.concat(F.lit('<div id="availability">Atualmente indisponível.</div>'), pay))
    body = body.when(kind == 2, F.concat(F.lit('<div id="unqualifiedBuyBox"></div>'), pay)).when(kind == 3, F.concat(swatch(True, vinyl), pay)).when(kind == 4, F.concat(swatch(True, F.lit("")), pay))
    body = body.when(kind == 5, F.lit('<div id="usedOnlyBuybox"></div>')).when(kind == 6, F.concat(F.lit('<span class="a-offscreen">ab R$ 1</span><span class="a-offscreen">'), _money(price), F.lit("</span>")))
    body = body.when(kind == 7, F.concat(F.lit('<div id="outOfStock">Currently unavailable</div>'), pay)).otherwise(F.lit('<div id="availability">Em estoque</div>'))
    head = F.concat(F.lit('<span id="productTitle"> '), F.col("p_name"), F.when(kind == 5, " [CD]").otherwise(""), F.lit(' </span><div id="bylineInfo"><span class="author"><a class="a-link-normal">'), F.col("p_brand"), F.lit('</a></span></div><img id="landingImage" src="https://i/x'), k, F.lit('._SX38_.jpg"><span id="acrCustomerReviewText">'), F.translate(F.format_number(k * 7 % 9000, 0), ",", "."), F.lit(" avaliações</span>"))
    return T.table(spark, d, "part").select(_key(k).alias("ext_key"), F.concat(F.lit("<html><body>"), head, body, F.lit("</body></html>")).alias("html"))


_PAGE_PRICE = "CASE p_partkey % 9 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice WHEN 3 THEN round(p_retailprice + 60, 2) WHEN 6 THEN p_retailprice WHEN 7 THEN p_retailprice END"


@query("html_products", f"""SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_name || CASE WHEN p_partkey % 9 = 5 THEN ' [CD]' ELSE '' END AS title, p_brand AS artist, {_PAGE_PRICE} AS price,
  p_partkey % 9 NOT IN (1, 7) AS in_stock, p_partkey % 9 IN (4, 5) AS non_vinyl, p_partkey % 9 = 5 AS used, CASE WHEN p_partkey % 9 = 3 THEN 'V' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS variant_key,
  CASE WHEN p_partkey % 9 <> 2 AND p_partkey * 7 % 9000 > 0 THEN CAST(p_partkey * 7 % 9000 AS INTEGER) END AS review_count, 'https://i/x' || p_partkey || '._AC_SX300_.jpg' AS image FROM part""")
def html_products(spark, d):
    return H.product_pages(product_pages(spark, d)).select("ext_key", "title", "artist", F.round("price", 2).alias("price"), "in_stock", "non_vinyl", "used", "variant_key", "review_count", "image")


@query("html_discovered", f"""SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_name AS title, {_PAGE_PRICE} AS price FROM part WHERE p_partkey % 9 IN (0, 3, 6)""")
def html_discovered(spark, d):
    return H.discovered_records(product_pages(spark, d)).select("ext_key", "title", F.round("price", 2).alias("price"))


@query("html_root_cause", """SELECT CASE p_partkey % 9 WHEN 2 THEN 'no_price_found' WHEN 4 THEN 'other_format' WHEN 5 THEN 'other_format' WHEN 8 THEN 'no_price_found' ELSE 'ok' END AS cause, count(*) AS n FROM part GROUP BY 1""")
def html_root_cause(spark, d):
    return H.root_cause(H.product_pages(product_pages(spark, d))).groupBy("cause").agg(F.count("*").alias("n"))


_ROBOT_TEXTS = [p.replace("you.re", "you're") for p in X.ROBOT_PATTERNS]


@query("html_price_causes", """SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice WHEN p_partkey % 7 = 6 THEN round(p_retailprice + 60, 2) END AS price,
  CASE p_partkey % 7 WHEN 1 THEN 'third_party_only' WHEN 2 THEN 'vinyl_out_of_stock' WHEN 3 THEN 'wrong_format_selected' WHEN 4 THEN 'robot_page' WHEN 5 THEN 'no_price_element' ELSE 'price_reachable' END AS price_cause FROM part""")
def html_price_causes(spark, d):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    pay = F.concat(F.lit('<div class="priceToPay"><span class="a-offscreen">'), _money(price), F.lit("</span></div>"))
    formats = lambda vinyl: F.concat(F.lit('<div id="tmmSwatches"><div class="swatchElement selected">CD</div><div class="swatchElement">Vinil'), vinyl, F.lit("</div></div>"))
    bare, priced = F.lit(""), F.concat(F.lit('<span aria-label="'), _money(price + 60), F.lit('"></span>'))
    robots = F.array(*map(F.lit, _ROBOT_TEXTS))
    body = F.when(k % 7 == 0, pay).when(k % 7 == 1, F.concat(F.lit('<div id="unqualifiedBuyBox"></div>'), pay)).when(k % 7 == 2, F.concat(F.lit('<div id="outOfStockBuyBox"></div>'), formats(bare))).when(k % 7 == 3, F.concat(formats(bare), pay))
    body = body.when(k % 7 == 4, F.concat(F.lit("<h4>"), F.element_at(robots, (F.floor(k / 7) % len(_ROBOT_TEXTS) + 1).cast("int")), F.lit("</h4>"), pay)).when(k % 7 == 5, F.lit('<div id="availability">Em estoque</div>')).otherwise(F.concat(formats(priced), pay))
    pages = T.table(spark, d, "part").select(_key(k).alias("ext_key"), F.concat(F.lit('<html><body><span id="productTitle">x</span>'), body, F.lit("</body></html>")).alias("html"))
    return H.price_causes(pages).select("ext_key", F.round("price", 2).alias("price"), "price_cause")


@query("recheck_outcomes", """SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, CASE WHEN p_partkey % 10 = 9 THEN 'skipped' WHEN p_partkey % 9 IN (4, 5) THEN 'non_vinyl' WHEN p_partkey % 9 IN (1, 7) THEN 'unavailable'
  WHEN p_partkey % 9 IN (2, 8) THEN 'deal_cleared' ELSE 'updated' END AS outcome FROM part""")
def recheck_outcomes(spark, d):
    robot = F.when(F.col("ext_key").endswith("9"), F.concat(F.col("html"), F.lit("<h4>Digite os caracteres que você vê</h4>"))).otherwise(F.col("html"))
    pages = product_pages(spark, d).withColumn("html", robot)
    rows = H.product_pages(pages.withColumn("blocked", X.blocked_page(F.col("html"))))
    return N.recheck_outcome(rows).select("ext_key", "outcome")


# --- artist searches and discovery -----------------------------------------------------------------------------------


def search_pages(spark, d) -> DataFrame:
    """``artist_name, page, rank, html``: search pages of each brand, of some 20 cards; rank is the brand's smallest number."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    kind = k % 6
    own = F.concat(F.lit('<div data-cy="price-recipe"><a class="a-text-bold" href="/dp/'), _key(k), F.lit('">Disco de  Vinil</a></div>'))
    other = lambda text: F.concat(F.lit(f"<div>{text} "), F.lit('<a href="/x/dp/v'), F.lpad(k.cast("string"), 9, "0"), F.lit('?y=1">Disco de Vinil</a></div>'))
    body = F.when(kind == 0, own).when(kind == 1, other("Outro formato:")).when(kind == 2, other("Veja")).when(kind == 3, F.concat(own, F.lit("<p>Nenhuma opção de compra em destaque</p>"))).when(kind == 4, other("Other formats:")).otherwise(F.lit("<p>CD</p>"))
    head = F.when(k % 2 == 0, F.concat(F.lit('<h2 aria-label="'), F.col("p_name"), F.lit('"><span>other</span></h2>'))).otherwise(F.concat(F.lit("<h2><span>"), F.col("p_name"), F.lit("</span></h2>")))
    prices = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(_price(F.lit("R$ 3,00")), _price(_money(price))))
    card = F.concat(F.lit('<div data-component-type="s-search-result" data-asin="'), F.when(k % 7 == 0, F.lit("short")).otherwise(F.lower(_key(k))), F.lit('">'), head, body, prices, F.lit("</div>"))
    cards = T.table(spark, d, "part").select(F.col("p_brand").alias("artist_name"), "p_partkey", card.alias("card"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "")
    pages = cards.groupBy("artist_name", F.floor(F.col("p_partkey") / 500).alias("page")).agg(joined.alias("html"))  # 25 brands
    return pages.join(cards.groupBy("artist_name").agg(F.min("p_partkey").alias("rank")), "artist_name")


_SEARCHED = """found AS (SELECT p_brand AS artist_name, CASE WHEN p_partkey % 6 = 0 THEN 'B' ELSE 'V' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_name AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, p_partkey FROM part WHERE p_partkey % 6 IN (0, 1, 4) AND p_partkey % 7 <> 0)"""


@query("html_artist_search", f"WITH {_SEARCHED} SELECT artist_name, ext_key, title, price FROM found")
def html_artist_search(spark, d):
    return H.artist_search_records(search_pages(spark, d)).select("artist_name", "ext_key", "title", F.round("price", 2).alias("price"))


@query("discovery_first_finder", f"""WITH {_SEARCHED} SELECT 'K' || right(ext_key, 2) AS ext_key, min(artist_name) AS artist_name FROM (SELECT *, rank() OVER (PARTITION BY right(ext_key, 2) ORDER BY b.r, artist_name) AS place FROM found
  JOIN (SELECT p_brand, min(p_partkey) AS r FROM part GROUP BY 1) b ON b.p_brand = artist_name) WHERE place = 1 GROUP BY 1""")
def discovery_first_finder(spark, d):
    finds = H.artist_search_records(search_pages(spark, d)).withColumn("ext_key", F.concat(F.lit("K"), F.right("ext_key", F.lit(2))))
    return D.first_finder(finds, "rank").select("ext_key", "artist_name")


@query("discovery_counts", f"""WITH {_SEARCHED}, s AS (SELECT DISTINCT p_brand AS artist, p_brand LIKE '%3' AS blocked FROM part), k AS (SELECT artist_name, count(*) AS n FROM found WHERE NOT artist_name LIKE '%4' GROUP BY 1),
  a AS (SELECT s.*, COALESCE(n, 0) AS n FROM s LEFT JOIN k ON artist_name = artist), f AS (SELECT DISTINCT ext_key, p_partkey FROM found WHERE NOT artist_name LIKE '%4')
  SELECT count(*) FILTER (WHERE n > 0 OR NOT blocked) AS processed, count(*) FILTER (WHERE n = 0 AND NOT blocked) AS empty, count(*) FILTER (WHERE blocked) AS blocked, (SELECT count(*) FROM f) AS found,
  (SELECT count(*) FROM f WHERE p_partkey % 3 <> 0) AS new, (SELECT count(*) FROM f WHERE p_partkey % 3 = 0) AS known FROM a""")
def discovery_counts(spark, d):
    finds = H.artist_search_records(search_pages(spark, d).where("artist_name not like '%4'")).select(F.col("artist_name").alias("artist"), "ext_key")
    searches = T.table(spark, d, "part").select(F.col("p_brand").alias("artist"), F.col("p_brand").endswith("3").alias("blocked")).distinct()
    number = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    known = T.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.explode(F.array(F.concat(F.lit("B"), number), F.concat(F.lit("V"), number))).alias("ext_key"))
    return D.run_counts_of(searches, finds, known)


@query("key_categories", "SELECT l_partkey AS ext_key, array_to_string(list_sort(list(DISTINCT 'u' || l_suppkey)), ',') AS urls FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def key_categories(spark, d):
    items = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("ext_key"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("u"), F.col("l_suppkey"))).alias("source_category_url"))
    return D.key_categories(items).select("ext_key", F.array_join("urls", ",").alias("urls"))


@query("new_keys", "SELECT c_custkey AS ext_key FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY 1 LIMIT 100")
def new_keys(spark, d):
    return D.new_keys(T.table(spark, d, "customer").selectExpr("c_custkey ext_key"), T.table(spark, d, "supplier").selectExpr("s_suppkey ext_key"))


@query("pending_first", "SELECT o_orderkey AS ext_key FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_first(spark, d):
    return D.pending_first(T.table(spark, d, "orders").selectExpr("o_orderkey ext_key", "o_orderdate discovered_at")).select("ext_key")


def _intake(spark, d, read_once=True):
    """A run of the intake; the records of the pages are stored, as several results take them and reading pages is most of the work."""
    products = T.table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("id"), _key(F.col("p_partkey")).alias("ext_key"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 8 == 0, 1).alias("deal_score"), F.lit(2).alias("price_count"), F.lit(True).alias("available"))
    obs = spark.createDataFrame([], "product_id string, price double, captured_at timestamp, obs_id long")
    waiting = T.table(spark, d, "part").where("p_partkey % 2 = 0").select(_key(F.col("p_partkey")).alias("ext_key"))
    processed = T.table(spark, d, "part").where("p_partkey % 2 = 0 and p_partkey % 10 <> 0").select(_key(F.col("p_partkey")).alias("ext_key"))
    records = H.discovered_records(product_pages(spark, d)).select("ext_key", F.upper("title").alias("title"), "price")
    if read_once:
        folder = run_folder(spark, "records")
        records.write.parquet(folder)
        records = spark.read.schema(records.schema).parquet(folder)
    return D.intake(products, obs, waiting, processed, records, as_of=NOW)


_TAKEN = "t AS (SELECT *, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AS processed, p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AND p_partkey % 9 IN (0, 3, 6) AS accepted FROM part)"


@query("intake_products", f"WITH {_TAKEN} SELECT ext_key, CASE WHEN accepted THEN upper(p_name) ELSE p_name END AS title, CAST(CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END + CAST(accepted AND p_partkey % 8 <> 0 AS INTEGER) AS INTEGER) AS price_count FROM t WHERE p_partkey % 4 = 0 OR accepted")
def intake_products(spark, d):
    return _intake(spark, d)[0].select("ext_key", "title", "price_count")


@query("intake_prices", f"WITH {_TAKEN} SELECT CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE ext_key END AS product_id, {_PAGE_PRICE} AS price FROM t WHERE accepted AND p_partkey % 8 <> 0")
def intake_prices(spark, d):
    return _intake(spark, d)[1].select("product_id", F.round("price", 2).alias("price"))


@query("intake_waiting", f"WITH {_TAKEN} SELECT ext_key FROM t WHERE p_partkey % 10 = 0")
def intake_waiting(spark, d):
    return _intake(spark, d, read_once=False)[2]  # without the records


@query("intake_counts", f"WITH {_TAKEN} SELECT count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected FROM t WHERE processed")
def intake_counts(spark, d):
    return _intake(spark, d)[3]


# --- the other halves of mutations -----------------------------------------------------------------------------------


@query("guarded_history", "SELECT l_partkey AS product_id, l_extendedprice AS price, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' OR l_partkey % 7 >= 3 GROUP BY 1, 2")
def guarded_history(spark, d):
    products = T.table(spark, d, "part").selectExpr("p_partkey id", "p_size price_count", "case when p_partkey % 7 < 3 then 1 end deal_score")
    obs, incoming = (T.table(spark, d, "lineitem").where(c).selectExpr("l_partkey product_id", "l_extendedprice price") for c in ("l_returnflag <> 'A'", "l_returnflag = 'A'"))
    return M.guarded_append(products, obs, incoming)[1].groupBy("product_id", "price").agg(F.count("*").alias("n"))


@query("recheck_history", "SELECT l_partkey AS product_id, count(*) AS n FROM lineitem GROUP BY 1")
def recheck_history(spark, d):
    products = T.table(spark, d, "part").selectExpr("p_partkey id", "p_size price_count", "true available", "cast(null as int) review_count")
    obs, incoming = (T.table(spark, d, "lineitem").where(c).selectExpr("l_partkey product_id", "l_extendedprice price") for c in ("l_returnflag <> 'R'", "l_returnflag = 'R'"))
    return M.append(products, obs, incoming)[1].groupBy("product_id").agg(F.count("*").alias("n"))


@query("recheck_reviews", "WITH f AS (SELECT l_partkey AS id, max(l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 3 GROUP BY 1) SELECT p_partkey AS id, COALESCE(r, p_size) AS review_count FROM part LEFT JOIN f ON f.id = p_partkey")
def recheck_reviews(spark, d):
    products = T.table(spark, d, "part").selectExpr("p_partkey id", "0 price_count", "true available", "p_size review_count")
    incoming = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey product_id", "l_extendedprice price", "case when l_linenumber <> 3 then l_linenumber end review_count")
    return M.append(products, incoming.where("1 = 0").select("product_id", "price"), incoming)[0].select("id", "review_count")


@query("deleted_products", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def deleted_products(spark, d):
    return M.delete_products(T.table(spark, d, "part").selectExpr("p_partkey id"), {}, T.table(spark, d, "supplier").selectExpr("s_suppkey id"))[0]


@query("inserted_table", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def inserted_table(spark, d):
    have = T.table(spark, d, "supplier").selectExpr("s_suppkey k", "s_name name")
    return M.insert_absent(have, T.table(spark, d, "customer").selectExpr("c_custkey k", "c_name name"), "k")[0]


@query("state_cursor", "SELECT n_nationkey AS k, CAST((n_nationkey + 1) % 13 AS INTEGER) AS next FROM nation")
def state_cursor(spark, d):
    return T.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), M.next_batch(F.col("n_nationkey")).cast("int").alias("next"))


@query("state_values", """SELECT n_name AS key, CASE WHEN n_name = 'NATION_3' THEN '12' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation
  UNION ALL SELECT 'read', '12' UNION ALL SELECT 'kept', max(CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_name = 'NATION_7' UNION ALL SELECT 'unset', '0' UNION ALL SELECT 'new', 'x'""")
def state_values(spark, d):
    state = T.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    table = M.set_state(M.set_state(state, "NATION_3", F.lit(12)), "new", F.lit("x"))
    read = lambda name, key, default: M.get_state(table, key, default).select(F.lit(name).alias("key"), "value")
    return table.unionByName(read("read", "NATION_3", None)).unionByName(read("kept", "NATION_7", None)).unionByName(read("unset", "nothing", "0"))


@query("variant_duplicates", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'duplicate' ELSE 'rename' END AS what FROM part WHERE p_partkey % 2 = 0")
def variant_duplicates(spark, d):
    part = T.table(spark, d, "part")
    changes = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), _key(F.col("p_partkey")).alias("new_key"))
    twice, once = M.drop_duplicates_of(changes, part.where("p_partkey % 3 = 0").select(_key(F.col("p_partkey")).alias("ext_key")))
    return twice.select("id", F.lit("duplicate").alias("what")).unionByName(once.select("id", F.lit("rename").alias("what")))


@query("deals_cleared", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 7 < 3 AND s_suppkey IS NULL THEN 1 END AS deal_score, epoch_us(CASE WHEN p_partkey % 7 < 3 AND s_suppkey IS NOT NULL THEN {LONG_AS_OF} END) // 1000000 AS last_flagged_at FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def deals_cleared(spark, d):
    products = T.table(spark, d, "part").selectExpr("p_partkey id", "case when p_partkey % 7 < 3 then 1 end deal_score", "cast(null as timestamp) last_flagged_at")
    return S.clear_deals(products, T.table(spark, d, "supplier").selectExpr("s_suppkey id"), as_of=NOW).select("id", "deal_score", seconds("last_flagged_at").alias("last_flagged_at"))


@query("score_run", f"""{_MOVED} SELECT count(*) AS total, count(*) FILTER (WHERE transition = 'maintained') AS scored, count(*) FILTER (WHERE transition = 'flagged') AS flagged, count(*) FILTER (WHERE transition = 'cleared') AS cleared,
  count(*) FILTER (WHERE cooled_down) AS skipped, count(*) FILTER (WHERE stale) AS stale, (SELECT count(*) FROM prod WHERE deal_score IS NOT NULL AND id NOT IN (SELECT product_id FROM obs WHERE price >= 20000)) AS orphans FROM moved""")
def score_run(spark, d):
    products = T.products(spark, d, with_benchmarks=False)
    return S.score_summary(moved(spark, d), S.orphans(products, T.observations(spark, d), floor=20000))


# --- whole pages -----------------------------------------------------------------------------------------------------


@query("home_grid", _grid_sql("desconto"))
def home_grid(spark, d):
    shown = C.home_page(T.products(spark, d), T.observations(spark, d), _chart(spark, d), as_of=NOW, days=DAYS)[0]
    return shown.withColumn("recent", cents()).select(*_GRID_COLUMNS)


@query("home_count", f"""{BASE}, {_LISTED}, n AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS pages FROM prod WHERE available AND price_count >= 5)
  SELECT total, pages, least(9999, pages) AS page, 9999 < pages AS has_more FROM n""")
def home_count(spark, d):
    return C.home_page(T.products(spark, d), T.observations(spark, d), _chart(spark, d), as_of=NOW, days=DAYS, page=9999)[1]


@query("home_carousel", SQL["carousel"])
def home_carousel(spark, d):
    rows = C.home_page(T.products(spark, d), T.observations(spark, d), _chart(spark, d), as_of=NOW, days=DAYS)[2]
    return rows.withColumn("recent", cents()).select(*_GRID_COLUMNS)


@query("home_no_carousel", "SELECT CAST(0 AS BIGINT) AS n")
def home_no_carousel(spark, d):
    return C.home_page(T.products(spark, d), T.observations(spark, d), _chart(spark, d), as_of=NOW, days=DAYS, search="red")[2].agg(F.count("*").alias("n"))


_YEAR = f"yr AS (SELECT * FROM obs WHERE captured_at >= {LONG_AS_OF} - INTERVAL 2000 DAY)"


@query("detail_page", f"""WITH {OBS}, {_YEAR}, own AS (SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey = 7), s AS (SELECT count(*) AS points, CAST(min(price) AS DOUBLE) AS low, CAST(max(price) AS DOUBLE) AS high, CAST(sum(price) AS DOUBLE) / count(*) AS mean FROM yr WHERE product_id = 7),
  l AS (SELECT CAST(price AS DOUBLE) AS latest FROM yr WHERE product_id = 7 ORDER BY captured_at DESC, obs_id DESC, price DESC LIMIT 1)
  SELECT id, title, CAST(points AS INTEGER) AS points, latest, low, high, mean, CASE WHEN points < 2 THEN NULL WHEN latest <= low THEN 'menor' WHEN latest > mean * 1.03 THEN 'aumento' ELSE 'estavel' END AS status,
  (SELECT epoch_us(max(captured_at)) // 1000000 FROM yr, s WHERE product_id = 7 AND CAST(price AS DOUBLE) = low) AS low_at, (SELECT epoch_us(max(captured_at)) // 1000000 FROM yr, s WHERE product_id = 7 AND CAST(price AS DOUBLE) = high) AS high_at FROM own, s, l""")
def detail_page(spark, d):
    rows = C.detail_page(T.products(spark, d, with_benchmarks=False).withColumn("slug", F.concat(F.lit("p"), F.col("id"))), T.observations(spark, d), "p7", as_of=NOW, days=2000)
    return rows.select("id", "title", "points", "latest", "low", "high", "mean", "status", seconds("low_at").alias("low_at"), seconds("high_at").alias("high_at"))


@query("detail_points", f"""WITH {OBS}, {_YEAR} SELECT epoch_us(captured_at) // 1000000 AS at, CAST(price AS DOUBLE) AS price, CAST(price AS DOUBLE) - CAST(lag(price) OVER (ORDER BY captured_at, obs_id, price) AS DOUBLE) AS delta,
  CASE WHEN CAST(captured_at - to_hours(CASE WHEN month(captured_at) IN (11, 12, 1) THEN 2 ELSE 3 END) AS DATE) IS NULL THEN NULL ELSE year(captured_at) END AS year FROM yr WHERE product_id = 7""")
def detail_points(spark, d):
    rows = C.detail_page(T.products(spark, d, with_benchmarks=False).withColumn("slug", F.concat(F.lit("p"), F.col("id"))), T.observations(spark, d), "p7", as_of=NOW, days=2000)
    return rows.select(F.explode("history").alias("h")).select(seconds("h.captured_at").alias("at"), "h.price", "h.delta", F.year("h.captured_at").cast("long").alias("year"))


@query("full_labels", "SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS label FROM events")
def full_labels(spark, d):
    return T.table(spark, d, "events").select("event_id", P.full_label(F.col("ts").cast("timestamp")).alias("label"))


@query("style_page_of_slug", f"""{BASE}, {latest_any()}, {recent('r', newest=False, floor=None)},
  s96 AS (SELECT p.*, n.price, COALESCE(avg_30d, n.price) AS mean_price, CASE WHEN COALESCE(avg_30d, 0) > 0 THEN (avg_30d - n.price) / avg_30d ELSE 0.0 END AS discount FROM prod p JOIN newest n ON n.product_id = p.id
    WHERE available AND price_count >= 5 AND list_contains(string_split(lower(tags), ', '), 'red') ORDER BY discount DESC NULLS LAST, id LIMIT 96)
  SELECT id, title, artist, slug, price, mean_price, discount, {_FRESH}, COALESCE(recent, '') AS recent, 'red' AS tag FROM s96 LEFT JOIN r ON r.product_id = id""")
def style_page_of_slug(spark, d):
    return C.style_page_of(T.products(spark, d), T.observations(spark, d), "red", as_of=NOW, days=DAYS).withColumn("recent", cents()).select(*_GRID_COLUMNS, "tag")


@query("enriched_tags", """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_type WHEN p_brand LIKE '%7' THEN NULL WHEN p_brand LIKE '%3' THEN '' ELSE 'rock, ' || lower(p_brand) END AS tags FROM part""")
def enriched_tags(spark, d):
    rows = T.table(spark, d, "part").selectExpr("p_partkey id", "p_brand artist", "case when p_partkey % 9 <> 0 then p_type end tags")
    body = F.when(F.col("artist").endswith("3"), F.lit('{"error": 6, "message": "none"}')).otherwise(F.concat(F.lit('{"toptags": {"tag": [{"name": "seen live"}, {"name": " Rock "}, {"name": "'), F.col("artist"), F.lit('"}]}}')))
    return C.enrich_tags(rows, rows.select("artist").distinct().where("artist not like '%7'").withColumn("payload", body), payloads.genre_tags(F.col("payload"))).select("id", "tags")


@query("ping_styles", "SELECT lower(p_type) AS style FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 <> 0")
def ping_styles(spark, d):
    return C.ping_styles(T.table(spark, d, "part").selectExpr("p_partkey % 11 <> 0 available", "case when p_partkey % 3 <> 0 then lower(p_type) end style"))


@query("deals_to_check", "SELECT row_number() OVER (ORDER BY p_partkey % 3 DESC, p_size, p_partkey) AS place, p_partkey AS id, COALESCE(CASE WHEN p_partkey % 5 <> 0 THEN p_name END, '') AS title FROM part WHERE p_partkey % 7 < 3")
def deals_to_check(spark, d):
    rows = T.table(spark, d, "part").selectExpr("p_partkey id", "'' ext_key", "case when p_partkey % 5 <> 0 then p_name end title", "case when p_partkey % 7 < 3 then p_partkey % 3 end deal_score", "p_size updated_at")
    return C.deals_to_check(rows).select("place", "id", "title")


_SPELT = "CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, 'e', 'é') WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END"


@query("portuguese_order", f"SELECT row_number() OVER (ORDER BY p_name) AS place, {_SPELT} AS name FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1)")
def portuguese_order(spark, d):
    first = T.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return L.numbered(first.select(F.expr(_SPELT).alias("name")), *C.portuguese_order("name"))


@query("json_numbers", "SELECT event_id, CAST(user_id AS DOUBLE) + 0.5 AS total, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 3 END AS n FROM events".replace("CAST(user_id AS DOUBLE) + 0.5", "CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE user_id + 0.5 END"))
def json_numbers(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("[1, 2")).otherwise(F.concat(F.lit("["), F.col("user_id"), F.lit(', "x", null, "0.5"]')))
    numbers = X.numbers_of_json(text)
    return T.table(spark, d, "events").select("event_id", F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(numbers).alias("n"))


@query("chart_axes", f"""WITH {OBS}, r AS (SELECT product_id, list(CAST(price AS DOUBLE) ORDER BY captured_at, obs_id) AS v FROM (SELECT * FROM obs WHERE captured_at >= {LONG_AS_OF} - INTERVAL 365 DAY AND price >= 30
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, obs_id DESC, price DESC) <= 10) GROUP BY product_id)
  SELECT product_id, list_min(v) * 0.8 + (list_max(v) * 1.1 - list_min(v) * 0.8) * 2 / 4 AS middle, CAST(len(v) - list_position(list_reverse(v), list_min(v)) AS INTEGER) AS low_at, CAST(len(v) - list_position(list_reverse(v), list_max(v)) AS INTEGER) AS high_at,
  CASE WHEN len(v) = 1 THEN '0' ELSE array_to_string([CAST(floor(i * (len(v) - 1) / CAST(least(len(v), 4) - 1 AS DOUBLE) + 0.5) AS INTEGER) FOR i IN range(least(len(v), 4))], ',') END AS x_ticks FROM r""")
def chart_axes(spark, d):
    from tidemark.operators import latest as L

    axis = P.chart_scale(F.col("recent"))
    return L.recent_prices(T.observations(spark, d), as_of=NOW, days=DAYS, floor=30).select("product_id", axis["ticks"][2].alias("middle"), axis["low_at"].alias("low_at"), axis["high_at"].alias("high_at"), F.array_join(F.transform(axis["x_ticks"], lambda x: x.cast("string")), ",").alias("x_ticks"))


@query("list_documents", f"""{BASE}, {_LISTED}, top AS (SELECT *, row_number() OVER (ORDER BY {_ORDERS['desconto']}) AS place FROM listed ORDER BY {_ORDERS['desconto']} LIMIT 24)
  SELECT count(*) AS n, string_agg(slug, ',' ORDER BY place) AS slugs FROM top""")
def list_documents(spark, d):
    page = C.grid(T.products(spark, d), T.observations(spark, d), as_of=NOW, days=DAYS)
    json = C.list_json(page, "Ofertas", "https://example.com", *C.sort_columns("desconto"))
    parsed = F.from_json("json", "numberOfItems long, itemListElement array<struct<position:int,url:string>>")
    return json.select(parsed.alias("x")).select(F.col("x.numberOfItems").alias("n"), F.array_join(F.transform("x.itemListElement", lambda i: F.regexp_extract(i["url"], "([^/]*)$", 1)), ",").alias("slugs"))


@query("trail_documents", """SELECT n_nationkey AS id, '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Início","item":"https://example.com/"},'
  || '{"@type":"ListItem","position":2,"name":"' || r_name || '","item":"https://example.com/estilo/' || r_regionkey || '"},{"@type":"ListItem","position":3,"name":"' || n_name || '","item":"https://example.com/artista/' || n_nationkey || '"}]}' AS json
  FROM nation JOIN region ON r_regionkey = n_regionkey""")
def trail_documents(spark, d):
    rows = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    at = lambda path, key: F.concat(F.lit(f"https://example.com/{path}/"), F.col(key).cast("string"))
    trail = C.breadcrumb_json([("Início", "https://example.com/"), (F.col("r_name"), at("estilo", "r_regionkey")), (F.col("n_name"), at("artista", "n_nationkey"))])
    return rows.select(F.col("n_nationkey").alias("id"), trail.alias("json"))


@query("run_plan", f"""{BASE}, {_QUEUE}, pend AS (SELECT *, COALESCE(CAST(sent_at - INTERVAL 3 HOUR AS DATE) = CAST(TIMESTAMP '2001-11-05 15:00:00' - INTERVAL 2 HOUR AS DATE) AND CASE WHEN ref_price > 0 THEN (ref_price - price) / ref_price ELSE 0 END < 0.1, false) AS again FROM synced WHERE status = 'pending'),
  seq AS (SELECT *, count(*) FILTER (WHERE NOT again) OVER (ORDER BY is_top_artist DESC NULLS LAST, priority_score DESC NULLS LAST, ext_key ROWS UNBOUNDED PRECEDING) AS sent_so_far FROM pend)
  SELECT ext_key, 'edit' AS action FROM synced WHERE status IN ('sent', 'pending') AND price < ref_price * 0.95
  UNION ALL SELECT ext_key, CASE WHEN again THEN 'discard' ELSE 'send' END FROM seq WHERE ((NOT again AND sent_so_far <= 5) OR (again AND sent_so_far < 5)) AND (SELECT max(o_orderdate + INTERVAL 1190 DAY) FROM orders) + INTERVAL 20 MINUTE <= TIMESTAMP '2001-11-05 15:00:00'""")
def run_plan(spark, d):
    queue, sent, _ = _queue(spark, d)
    return N.plan_run(queue, sent, as_of="2001-11-05 15:00:00")


@query("run_closed", "SELECT CAST(0 AS BIGINT) AS n")
def run_closed(spark, d):
    queue, sent, _ = _queue(spark, d)
    return N.plan_run(queue, sent, as_of="2001-11-05 03:00:00").agg(F.count("*").alias("n"))


@query("drip_gate", "SELECT event_id, hour(ts - INTERVAL 3 HOUR) >= 8 AND hour(ts - INTERVAL 3 HOUR) < 22 AND (event_id % 4 = 0 OR event_id % 60 >= 20) AS may_send FROM events")
def drip_gate(spark, d):
    ts = F.col("ts").cast("timestamp")
    last = F.when(F.col("event_id") % 4 != 0, ts - F.make_dt_interval(mins=(F.col("event_id") % 60).cast("int")))
    return T.table(spark, d, "events").select("event_id", N.run_gates(ts, last)[1].alias("may_send"))


@query("count_labels", "SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN 'Nenhum disco de vinil encontrado' WHEN 1 THEN '1 disco de vinil encontrado' ELSE r_regionkey || ' discos de vinil encontrados' END AS label FROM region")
def count_labels(spark, d):
    return T.table(spark, d, "region").select(F.col("r_regionkey").alias("k"), P.count_label(F.col("r_regionkey")).alias("label"))


@query("descriptions", """WITH t AS (SELECT doc_id, text, left(text, 155) AS cut FROM documents)
  SELECT doc_id, CASE WHEN length(text) <= 155 THEN text WHEN contains(cut[2:], ' ') THEN left(cut, CAST(length(cut) - strpos(reverse(cut), ' ') AS BIGINT)) || '…' ELSE cut || '…' END AS description FROM t""")
def descriptions(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.truncate_description(F.col("text")).alias("description"))


@query("word_capitals", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part")
def word_capitals(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.capitalize_words(F.col("p_name")).alias("name"))


@query("category_seed", "SELECT n_name AS name, 'https://example.com/c/' || n_nationkey AS url FROM nation")
def category_seed(spark, d):
    lists = T.table(spark, d, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))  # the seed is a short list
    return payloads.category_seed(lists.select(F.col("l.n_name").alias("names"), F.transform("l.n_nationkey", lambda k: F.concat(F.lit("https://example.com/c/"), k.cast("string"))).alias("urls")))


@query("page_results", f"""{BASE}, {_CHART} SELECT CASE WHEN {artist_slug('artist')} IN (SELECT slug FROM chart) THEN 'chart' ELSE 'other' END AS kind, count(DISTINCT artist) AS n FROM prod GROUP BY 1""")
def page_results(spark, d):
    rows = T.products(spark, d, with_benchmarks=False).withColumn("slug", X.artist_slug(F.col("artist"))).join(_chart(spark, d).withColumn("hit", F.lit(1)), "slug", "left")
    return rows.groupBy(F.when(F.col("hit") == 1, "chart").otherwise("other").alias("kind")).agg(F.count_distinct("artist").alias("n"))


@query("nan_rows", f"{BASE}, {_LISTED} SELECT count(*) AS n FROM listed WHERE id % 13 <> 0")
def nan_rows(spark, d):
    rows = C.with_latest(C.listed(T.products(spark, d)), T.observations(spark, d), floor=30)
    bad = F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("mean_price"))
    return C._numbers_ok(rows.withColumn("mean_price", bad)).agg(F.count("*").alias("n"))


@query("inverted_slugs", f"SELECT p_partkey AS id, {slug("split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)")} AS slug FROM part")
def inverted_slugs(spark, d):
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.compat_inverted_slug(name).alias("slug"))


@query("clean_titles", "SELECT p_partkey AS id, p_name AS title FROM part")
def clean_titles(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.clean_title(F.concat(F.lit("- "), F.col("p_name"), F.lit(" [Disco de Vinil] | "))).alias("title"))
