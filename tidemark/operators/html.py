"""Records from HTML at rest.

One Arrow stage per kind of page turns a document into the texts found by tables of selectors, in order of priority; what
those texts mean (titles, artists, prices, ratings) is decided by native column expressions, which also apply elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

from . import dom

FLOOR = 30.0

# Selectors of the pages, by priority.
CARD = "[data-component-type='s-search-result']"
TITLES = (
    "h2 a.a-link-normal span.a-text-normal", "h2 span.a-text-normal", "h2 a span", "h2 span", "[data-cy='title-recipe'] h2 span", "[data-cy='title-recipe'] span.a-text-normal",
    ".a-size-medium.a-color-base.a-text-normal", ".a-size-base-plus.a-color-base.a-text-normal", ".s-title-instructions-style span", ".a-size-medium.a-color-base", ".a-size-base-plus.a-color-base",
)
ARTISTS = (
    "span.author.notFaded a.a-link-normal", "span.author a.a-link-normal", "h2 ~ .a-row .a-color-secondary .a-size-base", "h2 ~ .a-row .a-color-secondary",
    "[data-cy='title-recipe'] ~ .a-row .a-color-secondary", ".s-title-instructions-style + div .a-color-secondary", ".a-row .a-size-base+ .a-size-base",
    "[data-cy='secondary-offer-recipe'] .a-color-secondary", ".a-section .a-color-secondary.a-size-base", ".a-size-small .a-color-secondary", ".s-line-clamp-2 + .a-row .a-size-base", ".a-size-base.a-color-secondary",
)
RATINGS = ("[aria-label*='de 5 estrelas']", "[aria-label*='out of 5 stars']", "[aria-label*='estrelas']", ".a-icon-star-small", ".a-icon-star")
REVIEWS = ("[aria-label*='classificações']", "[aria-label*='avaliações de clientes']", "[aria-label*='ratings']", "[aria-label*='customer reviews']")
IMAGES = ("img.s-image", "img[data-image-index]", ".s-product-image-container img")
PAGE_IMAGES = ("#landingImage", "#imgBlkFront", "#main-image")
PAGE_ARTISTS = ("#bylineInfo .author a.a-link-normal", "#bylineInfo a.a-link-normal", ".author.notFaded a")
PRICE_LABEL = "#apex-pricetopay-accessibility-label, [id$='-pricetopay-accessibility-label']"
ANY_LABEL = f"{PRICE_LABEL}, [id$='-accessibility-label'].aok-offscreen"
BUY_BOX = (".priceToPay", ".apex-pricetopay-value")
SECONDARY = ("secondary-offer-recipe", "format-list-recipe", "secondary-price-recipe")
INSTALMENT_WORDS = ("parcela", "parcel", "sem juros", "installment", "em até", "in up to", "x r$", "x de r$")
IN_STOCK = ("em estoque", "in stock", "disponível", "disponivel")
OUT_OF_STOCK = ("atualmente indisponível", "currently unavailable", "fora de estoque", "out of stock", "não disponível", "not available")
PROMOTIONS = ("ouça com amazon music", "ouça com music unlimited", "listen with amazon music", "adicionar ao carrinho", "add to cart", "comprar agora", "buy now", "patrocinado", "sponsored")


def _texts(node: dom.Node, selectors: tuple[str, ...], label: bool = False) -> list[str]:
    return [(n.get("aria-label") if label else "") or n.text() for n in node.firsts(selectors)]


def _secondary(node: dom.Node) -> bool:
    return any(a.get("data-cy") in SECONDARY or "s-secondary" in a.get("class") or "secondary-offer" in a.get("class") for a in node.ancestors())


def _instalment(node: dom.Node) -> bool:
    if "a-text-price" in node.get("class") or "s-installment" in node.get("class"):
        return True
    known = node.page.known
    for a, _ in zip(node.ancestors(), range(4), strict=False):
        says = known.get(a.at)
        if says is None:
            text = a.text(" ").lower()
            says = known[a.at] = any(w in text for w in INSTALMENT_WORDS)
        if says:
            return True
    return False


def _block_price(node: dom.Node) -> list[str]:
    """What a price block may say: its label, its hidden text, its whole and fraction."""
    label, hidden, whole, cents = (node.parent or node).first(ANY_LABEL), node.first(".a-offscreen"), node.first(".a-price-whole"), node.first(".a-price-fraction")
    out = [n.text() for n in (label, hidden) if n is not None]
    if whole is not None:
        digits = "".join(t for s in whole.strings() if (t := s.strip()) and t not in ",.").replace(".", "").rstrip(",")
        out.append(f"{digits},{cents.text() if cents is not None else '00'}")
    return out


def _card_prices(card: dom.Node) -> list[str]:
    out = []
    recipe, apex, section = card.first("[data-cy='price-recipe']"), card.first(".apex-core-price-identifier"), card.first(".s-price-instructions-style, .puis-price-instructions-style")
    if recipe is not None:
        out += _texts(recipe, (".a-price[data-a-size='xl'][data-a-color='base'] .a-offscreen",))
    if apex is not None:
        out += _texts(apex, (PRICE_LABEL,))
        out += [t for n in [apex.first(", ".join(BUY_BOX))] if n is not None and not _instalment(n) for t in _block_price(n)]
    if section is not None:
        out += [t for n in section.select(".a-price") if not _instalment(n) for t in _block_price(n)]
    out += [n.text() for s in ANY_LABEL.split(", ") if (n := card.first(s)) is not None and not _secondary(n)]
    for s in (*BUY_BOX, ".a-price[data-a-color='base']", ".a-price"):
        out += [t for n in card.select(s) if not _secondary(n) and not _instalment(n) for t in _block_price(n)]
    return out


def _image(node: dom.Node, selectors: tuple[str, ...], spare: str) -> str | None:
    for s in selectors:
        img = node.first(s)
        if img is None:
            continue
        url = img.get("src").strip() or img.get(spare).strip()
        if not url or url.startswith("data:"):
            entries = [e.split() for e in (img.get("srcset") or img.get("data-srcset")).split(",")]
            sizes = [(float(e[1].rstrip("xw")), e[0]) for e in entries if len(e) == 2 and e[1].rstrip("xw").replace(".", "", 1).isdigit()]
            url = max(sizes)[1] if sizes else ""
        if url and not url.startswith("data:"):
            return url
    return None


def _cards(root: dom.Node) -> list[dict]:
    return [
        {"ext_key": c.get("data-asin").strip(), "titles": _texts(c, TITLES), "artists": _texts(c, ARTISTS), "prices": _card_prices(c), "card_text": c.text(" "), "ratings": _texts(c, RATINGS, True), "reviews": _texts(c, REVIEWS, True), "image": _image(c, IMAGES, "data-src")}
        for c in root.select(CARD)
    ]


def _search_cards(root: dom.Node) -> list[dict]:
    """Cards of an artist search: the names of their own format, the links to other formats, title and prices."""
    out = []
    for c in root.select(f"{CARD}[data-asin]"):
        recipe, head = c.first("[data-cy='price-recipe']"), c.first("h2[aria-label]") or c.first("h2")
        links = [(a.text(), a.parent.text(" ") if a.parent is not None else "", a.get("href")) for a in c.select("a[href]")]
        out.append({
            "card_key": c.get("data-asin").strip().upper(), "card_text": c.text(" "), "own": [a.text() for a in recipe.select("a.a-text-bold")] if recipe is not None else [],
            "links": [x[0] for x in links], "near": [x[1] for x in links], "hrefs": [x[2] for x in links],
            "title": (head.get("aria-label").strip() or head.text(" ")) if head is not None else "", "prices": [n.text() for n in c.select(".a-price .a-offscreen")],
        })
    return out


def _vinyl(node: dom.Node) -> bool:
    low = node.text(" ").lower()
    return "vinil" in low or "vinyl" in low


def _product(root: dom.Node) -> list[dict]:
    has = lambda s: root.first(s) is not None
    text = lambda s: n.text(" ").lower() if (n := root.first(s)) is not None else None
    swatches, selected = root.select("#tmmSwatches .swatchElement"), root.first("#tmmSwatches .swatchElement.selected")
    switcher = has("#tmmSwatches")
    rows = [r for r in root.select("#twister .top-level") if _vinyl(r)] if switcher else []
    vinyl = [s for s in swatches if _vinyl(s)]
    table = [n.text() for r in rows if (n := r.first(".a-offscreen")) is not None] + [t for s in vinyl for t in [*(n.get("aria-label") for n in s.select("[aria-label]")), *(n.text() for n in [s.first(".a-offscreen")] if n is not None)]]
    box = []
    for s in BUY_BOX:
        n = root.first(s)
        if n is not None:
            box += [t for t in _block_price(n)[-2:]]
    links = [a.get("href") for s in vinyl if (a := s.first("a[href]")) is not None]
    is_vinyl = _vinyl(selected) if selected is not None else not switcher or not vinyl
    title = root.first("#productTitle")
    return [{
        "title": title.text() if title is not None else None, "artists": _texts(root, PAGE_ARTISTS), "ratings": _texts(root, RATINGS[:2], True), "reviews": _texts(root, ("#acrCustomerReviewText", "[data-hook='total-review-count']", *REVIEWS), True),
        "image": _image(root, PAGE_IMAGES, "data-old-hires"), "availability": text("#availability"), "badge": [n.text(" ").lower() for n in root.select("span.a-color-success")],
        "shut": [t for s in ("#outOfStock", "#soldByThirdParty") if (t := text(s))], "qualified": has("#qualifiedBuybox"), "unqualified": has("#unqualifiedBuyBox"), "used": has("#usedOnlyBuybox"), "vinyl_out": has("#outOfStockBuyBox"),
        "switcher": switcher, "vinyl_selected": is_vinyl, "other_formats_only": bool(swatches) and not vinyl, "table_prices": table, "box_prices": box, "loose_prices": [n.text() for n in root.select(".a-offscreen")] if not switcher else [],
        "variant_links": links if switcher and not (selected is not None and _vinyl(selected)) else [],
    }]


def _article(root: dom.Node) -> list[dict]:
    title = root.first("title")
    body = root.first("article") or root.first("body") or root
    return [{"title": title.text() if title is not None else None, "headings": [n.text(" ") for n in root.select("h1, h2, h3")], "links": [n.get("href") for n in root.select("a[href]")], "text": body.text(" ")}]


_STRINGS = pa.list_(pa.string())
_CARD_FIELDS = [("ext_key", pa.string()), ("titles", _STRINGS), ("artists", _STRINGS), ("prices", _STRINGS), ("card_text", pa.string()), ("ratings", _STRINGS), ("reviews", _STRINGS), ("image", pa.string())]
_PRODUCT_FIELDS = [
    ("title", pa.string()), ("artists", _STRINGS), ("ratings", _STRINGS), ("reviews", _STRINGS), ("image", pa.string()), ("availability", pa.string()), ("badge", _STRINGS), ("shut", _STRINGS),
    *((n, pa.bool_()) for n in ("qualified", "unqualified", "used", "vinyl_out", "switcher", "vinyl_selected", "other_formats_only")), ("table_prices", _STRINGS), ("box_prices", _STRINGS), ("loose_prices", _STRINGS), ("variant_links", _STRINGS),
]
_SEARCH_FIELDS = [("card_key", pa.string()), ("card_text", pa.string()), *((n, _STRINGS) for n in ("own", "links", "near", "hrefs")), ("title", pa.string()), ("prices", _STRINGS)]
_ARTICLE_FIELDS = [("title", pa.string()), ("headings", _STRINGS), ("links", _STRINGS), ("text", pa.string())]


#: Pages that one task reads at least and, once every core has its share of tasks, at most; so many tasks a core and in all.
TASK_PAGES, LONG_TASK_PAGES, CORE_TASKS, TASKS = 64, 2048, 4, 20_000


def _tasks(pages: int, cores: int) -> int:
    """Tasks for so many pages: enough for all cores, and no more of them than the work is worth, as each has a cost of its own."""
    return max(1, min(-(-pages // TASK_PAGES), max(CORE_TASKS * cores, -(-pages // LONG_TASK_PAGES)), TASKS))


def _extract(pages: DataFrame, read: Callable[[dom.Node], list[dict]], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """The rows that ``read`` finds in column ``html``, each with the page's other columns.

    Reading a page takes far longer than moving it, so pages are dealt out by their number, however few files or shuffle
    partitions they come in.
    """
    pages = pages.repartition(_tasks(pages.count(), pages.sparkSession.sparkContext.defaultParallelism))
    schema = pa.schema(fields)
    kept = [c for c in pages.columns if c != "html"]
    names = {pa.string(): "string", _STRINGS: "array<string>", pa.bool_(): "boolean"}
    ddl = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} {names[t]}" for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, r) for i, html in enumerate(part.column("html").to_pylist()) for r in read(dom.parse(html))]
                own = part.select(kept).take(pa.array([i for i, _ in found], pa.int64()))
                new = pa.RecordBatch.from_pylist([r for _, r in found], schema=schema)
                yield pa.RecordBatch.from_arrays([*own.columns, *new.columns], names=[*kept, *schema.names])

    return pages.mapInArrow(run, ddl)


def _first(texts: Column, read: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(texts, read), lambda x: F.coalesce(good(x), F.lit(False))), 0)


def first_price(texts: Column) -> Column:
    """The first text that reads as a price at or above the floor."""
    return _first(texts, X.parse_price, lambda p: p >= FLOOR)


# Texts that are no title, and titles of other formats.
RATING_TEXT, NUMBER_TEXT = r"(?i)^\d[\d,.]* de \d|^\d[\d.]* out of \d|estrelas?$", r"^[\d.,\s%R$]+$"
OTHER_TITLE = r"(?i)\bcd\b|\[cd\]|\(cd\)|compact disc|\bcd\s*\d|\bcassete\b|\bcassette\b|\bfita\s+cassete\b"


def choose_title(titles: Column) -> Column:
    """The longest of the texts that are titles (300 characters at most, else the first); null if none is."""
    no = lambda t: (F.length(t) <= 3) | t.rlike(RATING_TEXT) | t.rlike(NUMBER_TEXT) | F.exists(F.array(*map(F.lit, PROMOTIONS)), lambda p: F.lower(t).contains(p))
    good = F.filter(titles, lambda t: ~no(t))
    short = F.filter(good, lambda t: F.length(t) <= 300)
    longest = F.aggregate(short, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    return F.when(F.size(short) > 0, longest).otherwise(F.get(good, 0))


def choose_artist(texts: Column) -> Column:
    """The first plausible artist in normal form, or the placeholder."""
    return F.coalesce(X.normalize_artist(_first(texts, X.clean_artist, X.plausible_artist)), F.lit(X.UNKNOWN_ARTIST))


def listing_cards(pages: DataFrame) -> DataFrame:
    """Every card of listing pages, with ``skipped``: why it is no record (null: it is one)."""
    rows = _extract(pages, _cards, _CARD_FIELDS).withColumn("title", choose_title(F.col("titles"))).withColumn("artist", choose_artist(F.col("artists")))
    spare = F.regexp_extract_all("card_text", F.lit(r"R\$\s*[\d.,]+"), F.lit(0))
    rows = rows.withColumn("price", F.coalesce(first_price(F.col("prices")), first_price(spare)))
    rows = rows.withColumn("rating", _first(F.col("ratings"), X.parse_rating, lambda x: x.isNotNull())).withColumn("review_count", _first(F.col("reviews"), X.parse_review_count, lambda x: x.isNotNull()))
    why = F.when(F.col("ext_key") == "", "no_key").when(F.col("title").isNull(), "no_title").when(~X.vinyl_title(F.col("title")), "not_vinyl").when(F.col("price").isNull(), "no_price")
    return rows.withColumn("image", X.image_size(F.col("image"))).withColumn("slug", X.product_slug(F.col("title"), F.col("ext_key"))).withColumn("skipped", why).drop("titles", "artists", "prices", "card_text", "ratings", "reviews")


def listing_records(pages: DataFrame) -> DataFrame:
    """The records of listing pages; columns of the pages other than ``html`` are kept."""
    return listing_cards(pages).where("skipped is null").drop("skipped")


def skip_counts(pages: DataFrame) -> DataFrame:
    """``reason, n``: cards that are no record."""
    return listing_cards(pages).where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count("*").alias("n"))


def product_pages(pages: DataFrame, *, compat_stock: bool = False, with_cause: bool = False) -> DataFrame:
    """Product pages: title, artist, image, rating, review count, stock, price, format flags, ``variant_key``.

    Stock is assumed unless the page says otherwise.  The phrases for "out" are tested first, since those for "in" are part
    of some; ``compat_stock`` tests in the order of the original system.  A page of several formats gives the price of the
    vinyl one or none.  Pages without a qualified seller have no price.  ``with_cause`` adds ``price_cause``, see price_causes().
    """
    rows = _extract(pages, _product, _PRODUCT_FIELDS)
    says = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    out, ins = says(F.col("availability"), OUT_OF_STOCK), says(F.col("availability"), IN_STOCK)
    by_text = F.coalesce(ins | ~out, F.lit(True)) if compat_stock else F.coalesce(~out, F.lit(True))
    shut = F.exists("shut", lambda t: says(t, OUT_OF_STOCK))
    rows = rows.withColumn("in_stock", F.col("qualified") | (by_text & ~shut))
    table, box = first_price(F.col("table_prices")), first_price(F.col("box_prices"))
    loose = first_price(F.filter("loose_prices", lambda t: t.rlike(r"^(?:R\$|\d+[,.])")))
    no_offer = F.col("unqualified") & ~F.col("qualified")
    lost = F.col("switcher") & table.isNull() & (F.col("vinyl_out") | ~F.col("vinyl_selected"))
    price = F.when(no_offer | lost, None).when(table.isNotNull() & ~F.col("vinyl_selected"), table).otherwise(F.coalesce(box, loose))
    cause = F.when(no_offer, "third_party_only").when(F.col("switcher") & table.isNull() & F.col("vinyl_out"), "vinyl_out_of_stock").when(lost, "wrong_format_selected")
    cause = [cause.when(price.isNotNull(), "price_reachable").otherwise("no_price_element").alias("price_cause")] if with_cause else []
    reviews = F.when(~no_offer, _first(F.col("reviews"), X.parse_review_count, lambda x: x.isNotNull()))
    wrong_title = F.coalesce(F.col("title").rlike(OTHER_TITLE), F.lit(False))
    rows = rows.select("*", *cause).withColumn("price", price).withColumn("review_count", reviews).withColumn("artist", choose_artist(F.col("artists"))).withColumn("rating", _first(F.col("ratings"), X.parse_rating, lambda x: x.isNotNull()))
    rows = rows.withColumn("non_vinyl", wrong_title | F.col("other_formats_only")).withColumn("variant_key", _first(F.col("variant_links"), X.key_of_url, lambda x: x.isNotNull()))
    return rows.withColumn("image", X.image_size(F.col("image"))).select(*(c for c in pages.columns if c != "html"), "title", "artist", "image", "rating", "review_count", "in_stock", "price", "non_vinyl", "used", "variant_key", *(["price_cause"] if with_cause else []))


def price_causes(pages: DataFrame) -> DataFrame:
    """The pages' columns but ``html``, ``price`` and ``price_cause``: why a product page gives a price or none.

    In this order: ``robot_page`` (a check of the visitor instead of a page), ``third_party_only`` (no qualified seller),
    ``vinyl_out_of_stock`` and ``wrong_format_selected`` (several formats, no price in the vinyl row), ``price_reachable``,
    ``no_price_element``.
    """
    rows = product_pages(pages.withColumn("_robot", X.blocked_page(F.col("html"))), with_cause=True)
    robot = F.coalesce("_robot", F.lit(False))
    return rows.select(*(c for c in pages.columns if c != "html"), F.when(~robot, F.col("price")).alias("price"), F.when(robot, "robot_page").otherwise(F.col("price_cause")).alias("price_cause"))


def discovered_records(pages: DataFrame) -> DataFrame:
    """Full records of product pages with column ``ext_key``: those with a title, vinyl, in stock and with a price."""
    rows = product_pages(pages).where(F.col("title").isNotNull() & (F.col("title") != "") & X.vinyl_title(F.col("title")) & F.col("in_stock") & F.col("price").isNotNull())
    return rows.withColumn("slug", X.product_slug(F.col("title"), F.col("ext_key"))).drop("non_vinyl", "used", "variant_key", "in_stock")


# What artist searches say of formats and offers.
VINYL_FORMAT, OTHER_FORMAT, NO_OFFER = r"(?i)disco\s+de\s+vinil", r"(?i)outro\s+formato|other\s+format", r"(?i)nenhuma\s+op.+?de\s+compra\s+em\s+destaque"


def artist_search_records(pages: DataFrame) -> DataFrame:
    """``ext_key, title, price`` of the vinyl that pages of an artist search show; other columns of the pages are kept.

    A card counts if its own format is vinyl, or if it names vinyl as another format with a link that has a key, which is
    then the record's.  Cards without an offer or a key of ten signs give none; a price below the floor is null.
    """
    rows = _extract(pages, _search_cards, _SEARCH_FIELDS).where((F.length("card_key") == 10) & ~F.col("card_text").rlike(NO_OFFER))
    own = F.exists("own", lambda t: t.rlike(VINYL_FORMAT))
    others = F.filter(F.arrays_zip("links", "near", "hrefs"), lambda x: x["links"].rlike(VINYL_FORMAT) & x["near"].rlike(OTHER_FORMAT) & X.key_of_url(x["hrefs"]).isNotNull())
    rows = rows.withColumn("ext_key", F.when(own, F.col("card_key")).otherwise(X.key_of_url(F.get(others, 0)["hrefs"]))).withColumn("price", first_price(F.col("prices")))
    return rows.where("ext_key is not null").drop("card_key", "card_text", "own", "links", "near", "hrefs", "prices")


def with_references(pages: DataFrame, names: tuple[str, ...], title_names: tuple[str, ...]) -> DataFrame:
    """Pages of which only the named character references, each ended by a semicolon, are undone by reading; others stay as written.

    HTML also takes "&amp" for a sign, which a text that was cut within a reference does not mean.  ``title_names`` hold in
    the title.
    """
    other = lambda known: f"&(?!(?:{'|'.join(known)});)"
    in_title = "(?=[^<]*</title>)"
    return pages.withColumn("html", F.regexp_replace("html", f"{other(title_names)}{in_title}|{other(names)}", "&amp;"))


def articles(pages: DataFrame) -> DataFrame:
    """Title, headings, links and visible text of any page."""
    return _extract(pages, _article, _ARTICLE_FIELDS)


def has_next(pages: DataFrame) -> DataFrame:
    """``has_next`` of listing pages: a link to the next one, or cards at all."""
    more = F.col("html").rlike(r"""(?i)<a\b[^>]*class=["'][^"']*\bs-pagination-next\b""") | F.col("html").contains("s-search-result")
    return pages.withColumn("has_next", F.coalesce(more, F.lit(False)))


# Where pages name products.
KEY_PATTERNS = (r"""data-asin=["']\s*([A-Za-z0-9]{10})\s*["']""", r'"[Aa][Ss][Ii][Nn]"\s*:\s*"([A-Za-z0-9]{10})"')


def mined_keys(pages: DataFrame, patterns: tuple[str, ...] = KEY_PATTERNS) -> DataFrame:
    """``ext_key``: the distinct product keys, upper case, that attributes and script data of pages name."""
    found = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in patterns))
    return pages.select(F.explode(found).alias("k")).select(F.upper("k").alias("ext_key")).distinct()


def root_cause(rows: DataFrame) -> DataFrame:
    """``cause``: why a product page gave no price."""
    kind = F.when(F.col("price").isNotNull(), "ok").when(F.col("non_vinyl"), "other_format").when(F.col("used"), "used_only").when(~F.col("in_stock"), "out_of_stock").when(F.col("variant_key").isNotNull(), "variant").otherwise("no_price_found")
    return rows.withColumn("cause", kind)
