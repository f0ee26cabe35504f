"""Hand-made cases: boundaries of the rules, text helpers, changing tables, pages."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pricing as P
from tidemark.functions import text as X
from tidemark.operators import benchmarks as B
from tidemark.operators import catalog as C
from tidemark.operators import html as H
from tidemark.operators import latest as L
from tidemark.operators import merge as M
from tidemark.operators import notify as N
from tidemark.operators import scoring as S
from tidemark.sources import payloads, schemas

NOW = datetime(2024, 5, 1, 12)
AS_OF = "2024-05-01 12:00:00"


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_confidence_tiers(spark):
    cases = [(2, 40, "insufficient_data"), (3, 0, "insufficient_data"), (3, 1, "low_confidence"), (9, 44, "low_confidence"), (10, 13, "low_confidence"), (10, 14, "moderate_confidence"), (29, 45, "moderate_confidence"), (30, 44, "moderate_confidence"), (30, 45, "high_confidence")]
    df = spark.createDataFrame(cases, "p int, d int, want string")
    assert df.where(P.confidence_tier(F.col("p"), F.col("d")) != F.col("want")).count() == 0


def test_raw_scores(spark):
    cases = [
        (90.0, 100.0, 100.0, 50.0, "low_confidence", 1), (90.01, 100.0, 100.0, 50.0, "high_confidence", None), (17.0, 18.99, 18.0, 1.0, "low_confidence", None), (90.0, 100.0, 90.0, 50.0, "high_confidence", 1),
        (90.0, 100.0, 95.0, 50.0, "high_confidence", 2), (51.0, 100.0, None, 50.0, "moderate_confidence", 3), (51.01, 100.0, None, 50.0, "moderate_confidence", 1), (51.0, 100.0, None, 50.0, "low_confidence", 1),
        (50.0, 0.0, None, 50.0, "high_confidence", None), (50.0, None, None, 50.0, "high_confidence", None), (50.0, 100.0, 90.0, 50.0, "insufficient_data", None),
    ]
    df = spark.createDataFrame(cases, "p double, s double, l double, low double, c string, want int")
    got = P.raw_score(F.col("p"), F.col("s"), F.col("l"), F.col("low"), F.col("c"))
    assert df.where(~got.eqNullSafe(F.col("want"))).collect() == []


STATS = "product_id string, total_points long, history_days int, low_all_time double, avg_all double, avg_short_strict double, low_short double, avg_long double, avg_short double, current_price double, latest_at timestamp"


def stat(pid, price, low=10.0, at=NOW):
    return (pid, 20, 30, 10.0, 100.0, 100.0, low, 100.0, 100.0, price, at)


def test_cooldown_staleness_and_transitions(spark):
    h = lambda n, s=0: NOW - timedelta(hours=n, seconds=s)
    stats = spark.createDataFrame([stat("a", 80.0), stat("b", 80.0), stat("c", 76.0), stat("d", 10.0), stat("e", 80.0, at=h(48)), stat("f", 80.0, at=h(48, 1)), stat("g", 99.0), stat("h", 80.0)], STATS)
    old = [("a", None, h(5, 3599), 80.0), ("b", None, h(6), 80.0), ("c", None, h(1), 80.0), ("d", None, h(1), 10.0), ("e", 1, h(1), 80.0), ("f", 1, h(1), 80.0), ("g", 2, h(1), 80.0), ("h", None, h(1), None)]
    products = spark.createDataFrame(old, "id string, deal_score int, last_flagged_at timestamp, last_flagged_price double")
    got = {r.product_id: r for r in S.score_transitions(stats, products, as_of=AS_OF).collect()}
    assert {k: r.transition for k, r in got.items()} == {"a": "none", "b": "flagged", "c": "flagged", "d": "flagged", "e": "maintained", "f": "cleared", "g": "cleared", "h": "none"}
    assert got["a"].cooled_down and got["f"].stale and not got["e"].stale and got["f"].new_flagged_at == NOW
    summary = S.score_summary(S.score_transitions(stats, products, as_of=AS_OF)).first()
    assert (summary.total, summary.flagged, summary.cleared, summary.skipped, summary.stale) == (8, 3, 2, 2, 1)


def obs(spark, rows):
    return spark.createDataFrame([(p, Decimal(str(x)), t, i) for i, (p, x, t) in enumerate(rows)], "product_id string, price decimal(10,2), captured_at timestamp, obs_id long")


def test_latest_recent_and_benchmarks(spark):
    day = lambda n: NOW - timedelta(days=n)
    o = obs(spark, [("a", 50, day(1)), ("a", 60, day(1)), ("a", 20, NOW), ("b", 40, day(30)), ("b", 41, day(31)), *[("c", 100 + i, day(20 - i)) for i in range(11)]])
    latest = lambda **k: {r.product_id: float(r.price) for r in L.latest_price(o, **k).collect()}
    assert latest() == {"a": 20.0, "b": 40.0, "c": 110.0} and latest(floor=30)["a"] == 60.0
    recent = lambda **k: {r.product_id: r.recent for r in L.recent_prices(o, as_of=AS_OF, **k).collect()}
    assert recent()["c"] == [101.0 + i for i in range(10)] and recent(newest=False)["c"] == [100.0 + i for i in range(10)] and recent()["b"] == [40.0]
    stats = {r.product_id: r for r in B.benchmarks(o, as_of=AS_OF).collect()}
    assert stats["a"].total_points == 2 and stats["a"].history_days == 1 and stats["b"].avg_short == 40.0 and stats["b"].history_days == 1 and stats["a"].current_price == 60.0
    lows = {r.product_id: r for r in B.price_stats(obs(spark, [("x", 5, day(3)), ("x", 5, day(1)), ("x", 9, day(2))])).collect()}
    assert lows["x"].low_at == day(1) and lows["x"].mean == pytest.approx(19 / 3)
    empty = obs(spark, []) if False else o.where("1 = 0")
    assert L.latest_price(empty).count() == 0 and B.benchmarks(empty, as_of=AS_OF).count() == 0


def test_retention_keeps_exactly_a_year(spark):
    o = obs(spark, [("a", 1, NOW - timedelta(days=365)), ("a", 2, NOW - timedelta(days=365, seconds=1))])
    assert [float(r.price) for r in M.retain(o, as_of=AS_OF).collect()] == [1.0]


def test_slugs_and_names(spark):
    assert values(spark, X.artist_slug, ["SWIFT,TAYLOR", "Last,", "a, b, c", "Beyoncé", "Mötley Crüe ñ ý", "!!!", "x" * 70, None]) == ["taylor-swift", "last", "b-c-a", "beyonce", "motley-crue-n-y", "", "x" * 60, None]
    assert values(spark, X.compat_slug, ["ö", "ü", "ç", "ñ", "ý", "é"]) == ["u", "c", "n", "y", "", "e"]
    assert values(spark, X.compat_inverted_slug, ["Last, First, Extra"]) == ["first-last"]
    assert values(spark, X.normalize_artist, ["SWIFT,TAYLOR", "LED ZEPPELIN", "ABBA", "AC/DC", "king OF the hill", "THE QUEEN OF THE STONE AGE", None]) == ["Taylor Swift", "Led Zeppelin", "ABBA", "AC/DC", "king OF the hill", "The Queen of the Stone Age", None]
    assert values(spark, lambda c: X.product_slug(c, F.lit("B00ABC1234")), ["Álbum (Vinil)"]) == ["album-vinil-bc1234"]
    assert values(spark, X.plausible_artist, ["Queen", "R$ 10", "Oferta do dia", "12,50", "", None, "x" * 121, "123"]) == [True, False, False, False, False, False, False, False]
    assert values(spark, X.clean_artist, ["por Queen", "de: Queen", "Queen | 2022 (Deluxe)", "por$uicide"]) == ["Queen", "Queen", "Queen", "$uicide"]


def test_prices_and_counts(spark):
    assert values(spark, X.parse_price, ["R$ 1.234,56", "29,90", "29.90", "", "none", "R$\xa099,00", None]) == [1234.56, 29.9, 2990.0, None, None, 99.0, None]
    assert values(spark, X.parse_review_count, ["1.235 classificações", "0", "none", "12"]) == [1235, None, None, 12]
    assert values(spark, X.parse_rating, ["4,5 de 5 estrelas", "4.7 out of 5", "6 de 5", "x"]) == [4.5, 4.7, None, None]
    assert values(spark, X.brl, [1234.56, 0.5], "double") == ["1.234,56", "0,50"]
    assert values(spark, X.clean_title, ["Album [Disco de Vinil] - ", "Album (2 LP) x"]) == ["Album", "Album x"]
    assert values(spark, X.key_of_url, ["/x/dp/b00abc1234/ref", "/x"]) == ["B00ABC1234", None]
    assert values(spark, X.truncate_title, ["a | b | " + "c" * 60, "d" * 70]) == ["a | b", "d" * 60]
    assert P.page_range(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10] and P.page_range(1, 7) == list(range(1, 8))


def test_tags_and_payloads(spark):
    assert values(spark, X.parse_tags, [None, "", "a, b,,c "]) == [[], [], ["a", "b", "c"]]
    bodies = ['{"toptags":{"tag":[{"name":"Seen Live"},{"name":"Rock"},{"name":"x"},{"name":"Jazz"},{"name":"Soul"},{"name":"Pop"}]}}', '{"error":6,"message":"no"}', "bad", None]
    assert values(spark, payloads.genre_tags, bodies) == [["rock", "jazz", "soul"], [], [], []]
    chart = spark.createDataFrame([(1, '{"artists":{"artist":[{"name":"A"},{"name":"B"}]}}'), (2, '{"artists":{"artist":[{"name":"A"},{"name":"C"}]}}')], "page int, payload string")
    assert {r.name: r.rank for r in payloads.chart_names(chart).collect()} == {"A": 1, "B": 2, "C": 4}


def test_search(spark):
    rows = [("1", "Kind of Blue", "Miles Davis", 5, True, 10.0), ("2", "Blue Train", "John Coltrane", 5, True, 20.0), ("3", "São Paulo", "Caetano", 5, True, None)]
    p = spark.createDataFrame(rows, "id string, title string, artist string, price_count int, available boolean, avg_30d double").withColumn("slug", F.col("id")).withColumn("img_url", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("string"))
    ids = lambda term: {r.id for r in C.listed(p, search=term).collect()}
    assert ids("blu mil") == {"1"} and ids("blu") == {"1", "2"} and ids("sao") == set() and ids("são") == {"3"} and ids("%") == set()
    assert [r.id for r in C.suggestions(p, "blue tra").collect()] == ["2"] and C.suggestions(p, "b").count() == 0
    with pytest.raises(ValueError):
        C.sort_columns("random")


def test_upsert_is_idempotent_and_keeps_what_it_should(spark):
    old = schemas.reconcile(spark.createDataFrame([("1", "K1", "Old", "rock", 5), ("2", "K2", "Two", None, 7)], "id string, ext_key string, title string, style string, review_count int"), schemas.PRODUCT)
    old = old.withColumn("slug", F.concat(F.lit("s"), F.col("id"))).withColumn("price_count", F.lit(3)).withColumn("available", F.lit(True))
    t = lambda h: NOW - timedelta(hours=h)
    new = spark.createDataFrame([("K1", "First", None, None, "x", t(2)), ("K1", "Last", None, None, "x", t(1)), ("K3", "New", "jazz", 1, "s3", t(1))], "ext_key string, title string, style string, review_count int, slug string, captured_at timestamp")
    once = M.upsert_products(old, new, as_of=AS_OF)
    got = {r.ext_key: r for r in once.collect()}
    assert (got["K1"].title, got["K1"].style, got["K1"].review_count, got["K1"].slug) == ("Last", "rock", 5, "s1") and got["K3"].slug == "s3" and got["K3"].available and got["K2"].title == "Two"
    assert sorted(map(tuple, M.upsert_products(once, new, as_of=AS_OF).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(r.ext_key for r in M.upsert_products(old, new.where("1 = 0"), as_of=AS_OF).collect()) == ["K1", "K2"]


def test_links_and_guarded_append(spark):
    products = spark.createDataFrame([("1", "K1", None, 2, True), ("2", "K2", 3, 2, True)], "id string, ext_key string, deal_score int, price_count int, available boolean")
    o = obs(spark, [("1", 50, NOW)])
    incoming = o.unionByName(o.withColumn("product_id", F.lit("2")))
    after, history = M.guarded_append(products, o, incoming)
    assert {r.id: r.price_count for r in after.collect()} == {"1": 3, "2": 2} and history.count() == 2
    links = spark.createDataFrame([("1", 7, NOW - timedelta(days=9), NOW - timedelta(days=1))], schemas.PRODUCT_CATEGORY)
    cats = spark.createDataFrame([(7, "u7"), (8, "u8")], "id int, url string")
    pairs = spark.createDataFrame([("K1", "u7"), ("K1", "u8"), ("K9", "u7"), ("K1", "u9"), ("K1", "u8")], "ext_key string, url string")
    got = {r.category_id: (r.first_seen_at, r.last_seen_at) for r in M.upsert_links(links, pairs, products, cats, as_of=AS_OF).collect()}
    assert got == {7: (NOW - timedelta(days=9), NOW), 8: (NOW, NOW)}


QUEUE = "ext_key string, status string, first_seen_at timestamp, price decimal(10,2), priority_score double, is_top_artist boolean"


def test_queue(spark):
    h = lambda n, m=0: NOW - timedelta(hours=n, minutes=m)
    d = Decimal
    queue = spark.createDataFrame([("a", "pending", h(5, 59), d(100), 1.0, False), ("b", "pending", h(6, 1), d(100), 1.0, False), ("c", "discarded", h(1), d(100), 1.0, False), ("d", "sent", h(9), d(100), 1.0, False), ("e", "pending", h(1), d(100), 1.0, False), ("f", "sent", h(9), d(89), 1.0, False), ("g", "sent", h(9), d(90), 1.0, False)], QUEUE)
    deals = spark.createDataFrame([(k, "Queen", d(p), d(120)) for k, p in (("a", 100), ("b", 100), ("c", 100), ("d", 100), ("f", 89), ("g", 90), ("n", 60))], "ext_key string, artist string, price decimal(10,2), avg_30d decimal(10,2)")
    sent = spark.createDataFrame([(1, k, h(7), d(100), 1, None, None) for k in "dfg"], "id int, ext_key string, sent_at timestamp, price decimal(10,2), message_id long, last_edited_at timestamp, last_edit_price decimal(10,2)")
    top = spark.createDataFrame([("queen",)], "slug string")
    after = N.sync_queue(queue, deals, sent, top, as_of=AS_OF)
    assert {r.ext_key: r.status for r in after.collect()} == {"a": "pending", "b": "discarded", "c": "pending", "d": "sent", "e": "discarded", "f": "pending", "g": "sent", "n": "pending"}
    assert {r.ext_key for r in N.edits(after, sent).collect()} == {"f", "g"}
    picked = {r.ext_key: r.action for r in N.next_messages(after, sent, as_of=AS_OF, n=2).collect()}
    assert picked == {"n": "send", "f": "send"}
    same_day = sent.withColumn("sent_at", F.lit(AS_OF).cast("timestamp")).withColumn("price", F.lit(95).cast("decimal(10,2)"))
    assert N.next_messages(after, same_day, as_of=AS_OF, n=9).where("ext_key = 'f'").first().action == "discard"
    assert N.next_messages(after.where("1 = 0"), sent, as_of=AS_OF).count() == 0


CARD = """<div data-component-type="s-search-result" data-asin="{key}"><h2><a><span>{title}</span></a></h2><div class="a-row"><span class="a-color-secondary"><span class="a-size-base">por Queen</span></span></div>
<span aria-label="4,5 de 5 estrelas"></span><span aria-label="1.235 classificações"></span><img class="s-image" src="https://i/x._AC_UL320_.jpg">
<div class="a-section"><span class="a-price" data-a-color="base"><span class="a-offscreen">{price}</span></span></div>{more}</div>"""


def test_listing_pages(spark):
    card = lambda **k: CARD.format(**({"key": "B000000001", "title": "A Night at the Opera", "price": "R$ 199,90", "more": ""} | k))
    html = "".join((card(), card(key="", title="No key"), card(key="B000000002", title="Some CD set"), card(key="B000000003", price="R$ 9,90"), card(key="B000000004", title="R$ 12")))
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<p>x")], "page_id int, html string")
    rows = H.listing_records(pages).collect()
    assert [(r.page_id, r.ext_key, r.title, r.artist, r.price, r.rating, r.review_count) for r in rows] == [(1, "B000000001", "A Night at the Opera", "Queen", 199.9, 4.5, 1235)]
    assert rows[0].image == "https://i/x._AC_SX300_.jpg" and rows[0].slug == "a-night-at-the-opera-000001"
    assert {r.reason: r.n for r in H.skip_counts(pages).collect()} == {"no_key": 1, "not_vinyl": 1, "no_price": 1, "no_title": 1}
    assert {r.page_id for r in H.has_next(pages).where("has_next").collect()} == {1}


def test_product_pages(spark):
    price = '<div class="priceToPay"><span class="a-offscreen">R$ 150,00</span></div>'
    cases = {
        1: f"<span id='productTitle'>Album</span><div id='availability'>Em estoque</div>{price}",
        2: f"<div id='availability'>Atualmente indisponível.</div>{price}",
        3: f"<div id='unqualifiedBuyBox'></div>{price}",
        4: f"<div id='tmmSwatches'><div class='swatchElement selected'>CD</div><div class='swatchElement'>Vinil <a href='/dp/B000000009'>v</a><span aria-label='R$ 210,00'></span></div></div>{price}",
        5: f"<div id='tmmSwatches'><div class='swatchElement selected'>CD</div></div>{price}",
        6: "<div id='usedOnlyBuybox'></div><span id='productTitle'>Album [CD]</span>",
        7: "<div class='priceToPay'><span class='a-price-whole'>1.234,</span><span class='a-price-fraction'>50</span></div>",
    }
    got = {r.k: r for r in H.product_pages(spark.createDataFrame(list(cases.items()), "k int, html string")).collect()}
    assert {k: r.price for k, r in got.items()} == {1: 150.0, 2: 150.0, 3: None, 4: 210.0, 5: None, 6: None, 7: 1234.5}
    assert got[1].in_stock and not got[2].in_stock and got[4].variant_key == "B000000009" and got[5].non_vinyl and got[6].used and got[6].non_vinyl
    assert H.product_pages(spark.createDataFrame([(2, cases[2])], "k int, html string"), compat_stock=True).first().in_stock


def test_related_tags_and_style_slugs(spark):
    p = spark.createDataFrame([("1", "rock, pop", True), ("2", "Rock, jazz", True), ("3", "pop", True), ("4", "rock", False), ("5", None, True), ("6", "", True)], "id string, tags string, available boolean")
    got = {r.tag: r.jaccard for r in C.related_tags(p, "Rock").collect()}
    assert got == {"pop": pytest.approx(1 / 3), "jazz": pytest.approx(1 / 2)} and all(0 < v <= 1 for v in got.values())
    assert {r.slug for r in C.style_slugs(p).collect()} == {"rock", "pop", "jazz"}


def test_stream_batches(spark, tmp_path):
    from tidemark.streaming import ingest

    seen = []
    stream = ingest.events_stream(spark, "/root/testdata/sf0.001")
    ingest.each_batch(ingest.distinct_observations(stream), lambda df, n: seen.append(df.count()), str(tmp_path / "c")).awaitTermination(120)
    assert sum(seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_stored_prices_are_those_of_the_observations(spark):
    o = obs(spark, [("1", 50, NOW - timedelta(days=3)), ("1", 20, NOW), ("2", 10, NOW), ("3", 40, NOW)])
    stats = B.benchmarks(o, as_of=AS_OF, with_rest=True)
    got = {r.product_id: (r.price_count, r.total_points, r.latest_any, r.current_price, r.history_days) for r in stats.collect()}
    assert got == {"1": (2, 1, 20.0, 50.0, 1), "2": (1, 0, 10.0, None, None), "3": (1, 1, 40.0, 40.0, 1)}
    plain = B.benchmarks(o, as_of=AS_OF)
    assert sorted(map(str, stats.where("total_points > 0").select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_numbers_of_json_and_axes(spark):
    rows = spark.createDataFrame([(1, '[1, "2.5", "x", null, ""]'), (2, "[1"), (3, None), (4, "[]")], "k int, t string")
    assert {r.k: r.n for r in rows.select("k", X.numbers_of_json(F.col("t")).alias("n")).collect()} == {1: [1.0, 2.5, 0.0, 0.0], 2: [], 3: [], 4: []}
    values = spark.createDataFrame([([5.0, 1.0, 9.0, 1.0, 9.0, 3.0, 4.0],), ([2.0],), ([],)], "v array<double>")
    got = [r.a for r in values.select(P.chart_scale(F.col("v")).alias("a")).collect()]
    assert (got[0].x_ticks, got[0].low_at, got[0].high_at) == ([0, 2, 4, 6], 3, 4) and got[1].x_ticks == [0] and got[2].x_ticks is None


def test_blocked_pages(spark):
    pages = ["<h4>Digite os CARACTERES que você vê", "We just need to make sure you're not a robot", "<p>VERIFICAÇÃO DE ROBÔ", "robots in vinyl", "", None]
    assert values(spark, lambda x: F.coalesce(X.blocked_page(x), F.lit(False)), pages) == [True, True, True, False, False, False]


def test_references_of_cut_texts(spark):
    """A title cut within a reference, and a reference that titles keep, stay as they are written."""
    html = "<title>a&amp;b &quot;c&amp</title><article><h1>a&amp;b &quot;c&amp</h1><p>x &middot; &amp;quot; &lt;</p></article><a href='/x?a=1&amp;b=2&c'>"
    pages = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    got = {r.k: r for r in H.articles(H.with_references(pages, ("quot", "middot", "copy", "amp"), ("amp",))).collect()}
    assert (got[1].title, got[1].text, got[1].links) == ("a&b &quot;c&amp", 'a&b "c&amp x · &quot; &lt;', ["/x?a=1&b=2&c"]) and got[2].title is None
    assert H.articles(pages).where("k = 1").first().title == 'a&b "c&'


def test_title_query_on_cut_titles(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalogue

    html = "<title>x &amp</title><body><article><h1>x &amp</h1> y &quot;z&quot;</article></body>"
    spark.createDataFrame([(1, html), (2, html.replace("x ", "&quot;"))], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, catalogue.QUERIES["html_titles"](spark, str(tmp_path)).collect())) == sorted(con.execute(catalogue.SQL["html_titles"]).fetchall())
