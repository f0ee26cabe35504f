"""Queries over tables at rest: search index, benchmarks by increments, partitioned history, lookups by slug; each with its SQL.

Every query writes its table to a folder of its own in the shared place and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import merge as M
from tidemark.operators import rollups as R
from tidemark.operators import search_index as I
from tidemark.sources import history as H
from tidemark.sources import keyed as Y
from tidemark.sources import lookups as K
from tidemark.sources import tables as T
from tidemark.sources.shared import run_folder
from tidemark.streaming import ingest, timers

from .catalogue import _GRID_COLUMNS, _TAGS, DAYS, NOW, SQL, cents, query, seconds
from .tables_sql import BASE, LONG_AS_OF, OBS

# --- search index ----------------------------------------------------------------------------------------------------


def _index(spark, d, products=None):
    products = T.products(spark, d, with_benchmarks=False) if products is None else products
    return I.write_index(I.postings(products), run_folder(spark, "postings"))


def _words_sql(source: str) -> str:
    """``w``: the words of artist (A) and title (B) with their positions, and ``post``: one row for each word of a product."""
    split = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""l AS (SELECT id, {split('artist')} AS a, {split('title')} AS b FROM {source}),
w AS (SELECT id, unnest(a) AS token, generate_subscripts(a, 1) AS pos, 'A' AS weight FROM l UNION ALL SELECT id, unnest(b), generate_subscripts(b, 1) + len(a), 'B' FROM l),
post AS (SELECT token, id, string_agg(CAST(pos AS VARCHAR) || weight, ',' ORDER BY pos) AS places FROM w GROUP BY token, id)"""


def _flat(index):
    return index.select("token", "id", F.array_join(F.transform("places", lambda p: F.concat(p["pos"].cast("string"), p["weight"])), ",").alias("places"))


@query("search_index", f"{BASE}, {_words_sql('prod')} SELECT token, id, places FROM post")
def search_index(spark, d):
    return _flat(_index(spark, d))


@query("search_index_changed", f"{BASE}, new AS (SELECT id, artist, CASE WHEN id % 10 = 0 THEN 'Live ' || style || ' live' ELSE title END AS title FROM prod), {_words_sql('new')} SELECT token, id, places FROM post")
def search_index_changed(spark, d):
    products = T.products(spark, d, with_benchmarks=False)
    changed = products.where("id % 10 = 0").select("id", "artist", F.concat(F.lit("Live "), "style", F.lit(" live")).alias("title"))
    return _flat(I.write_index(I.with_changes(_index(spark, d), changed), run_folder(spark, "postings")))


@query("search_by_index", SQL["grid_search"])
def search_by_index(spark, d):
    """The rows of grid_search, with the products found in the index."""
    products = I.listed_by_index(T.products(spark, d), _index(spark, d), "re bra")
    return C.grid(products, T.observations(spark, d), as_of=NOW, days=DAYS, sort="az").withColumn("recent", cents()).select(*_GRID_COLUMNS)


_W = "CASE weight WHEN 'A' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END"
_SUGGESTED = "SELECT id, title, artist, slug, img_url, avg_30d AS avg_price, round(rank, 9) AS rank FROM prod JOIN ranked USING (id) WHERE available AND price_count >= 5 ORDER BY rank DESC, avg_price DESC NULLS LAST, id LIMIT 8"


@query("search_ranked", f"""{BASE}, {_words_sql('prod')}, u AS (SELECT id, token, pos, {_W} AS wt FROM w),
  y AS (SELECT * FROM u WHERE starts_with(token, 'brand')), z0 AS (SELECT * FROM u WHERE starts_with(token, 'bl')),
  z AS (SELECT z0.* FROM z0 JOIN (SELECT id, max(token) AS token FROM z0 GROUP BY id) USING (id, token)),
  p AS (SELECT y.id, abs(y.pos - z.pos) AS far, y.wt * z.wt AS ww, y.pos <> z.pos AS apart FROM y JOIN z ON y.id = z.id),
  ranked AS (SELECT id, 1 - product(CASE WHEN apart THEN 1 - sqrt(ww * CASE WHEN far > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(far / CAST(1.5 AS DOUBLE) - 2)) END) ELSE 1 END) AS rank FROM p GROUP BY id) {_SUGGESTED}""")
def search_ranked(spark, d):
    return I.ranked_suggestions(T.products(spark, d), _index(spark, d), "bl brand").withColumn("rank", F.round("rank", 9))


@query("search_ranked_word", f"""{BASE}, {_words_sql('prod')}, u AS (SELECT id, token, {_W} AS wt, row_number() OVER (PARTITION BY id, token ORDER BY pos) AS i FROM w WHERE starts_with(token, 'b')),
  t AS (SELECT id, token, max(wt) AS best, sum(wt / (i * i)) AS damped FROM u GROUP BY id, token), f AS (SELECT u.id, u.token, min(i) AS i FROM u JOIN t ON u.id = t.id AND u.token = t.token AND u.wt = t.best GROUP BY u.id, u.token),
  ranked AS (SELECT t.id, sum((best + damped - best / (f.i * f.i)) / CAST(1.64493406685 AS DOUBLE)) AS rank FROM t JOIN f ON t.id = f.id AND t.token = f.token GROUP BY t.id)
  {_SUGGESTED.replace('WHERE available', "WHERE starts_with(title, 'b') AND available")}""")
def search_ranked_word(spark, d):
    """One prefix of two characters is asked for; of what begins with b here, so that several words of a product count."""
    products = T.products(spark, d).where(F.col("title").startswith("b"))
    found = I.matches(_index(spark, d), ["b"]).select("id", I.text_rank(F.col("hits"), ["b"]).alias("rank"))
    rows = products.where("available and price_count >= 5").join(found, "id").withColumn("avg_price", F.col("avg_30d").cast("double"))
    return rows.orderBy(F.desc(F.round("rank", 9)), F.desc_nulls_last("avg_price"), "id").limit(8).select("id", "title", "artist", "slug", "img_url", "avg_price", F.round("rank", 9).alias("rank"))


# --- benchmarks by increments ----------------------------------------------------------------------------------------


def _batches(spark, folder, obs):
    for k in (0, 1, 2, 1):  # one of them twice
        R.add_batch(obs.where(F.col("obs_id") % 3 == k), folder, f"b{k}")
    return R.read_batches(spark, folder)


def _stats(rows):
    return rows.select("product_id", "total_points", "history_days", "low_all_time", "avg_all", "avg_short_strict", "low_short", "avg_long", "avg_short", "current_price", seconds("latest_at").alias("latest_at"))


@query("benchmarks_by_batches", SQL["benchmarks_long"])
def benchmarks_by_batches(spark, d):
    days, totals = _batches(spark, run_folder(spark, "rollups"), T.observations(spark, d))
    return _stats(R.benchmarks_of(totals, days, as_of=NOW, short_days=DAYS, long_days=T.LONG.long_days))


@query("benchmarks_by_batches_dense", SQL["benchmarks_dense"])
def benchmarks_by_batches_dense(spark, d):
    days, totals = _batches(spark, run_folder(spark, "rollups"), T.dense_observations(spark, d))
    return _stats(R.benchmarks_of(totals, days, as_of=T.DENSE.as_of, short_days=T.DENSE.short_days, long_days=T.DENSE.long_days))


_LATER = "2001-10-01 12:00:00"


@query("benchmarks_within_a_day", SQL["benchmarks_long"].replace(LONG_AS_OF, f"TIMESTAMP '{_LATER}'"))
def benchmarks_within_a_day(spark, d):
    """At noon the windows start within a day, whose observations come from the stored history; so do those that are added up."""
    folder = run_folder(spark, "rollups")
    H.append_batch(T.observations(spark, d), f"{folder}-history", "all")
    obs = H.read_history(spark, f"{folder}-history")
    R.add_batch(obs, folder, "all")
    R.compact(spark, folder, f"{folder}-compact")
    days, totals = R.read_batches(spark, f"{folder}-compact")
    return _stats(R.benchmarks_of(totals, days, as_of=_LATER, short_days=DAYS, long_days=T.LONG.long_days, observations=obs))


# --- history at rest -------------------------------------------------------------------------------------------------


def _stored_history(spark, d):
    folder, obs = run_folder(spark, "history"), T.observations(spark, d)
    for k in (0, 1, 0):  # one of them twice
        H.append_batch(obs.where(F.col("obs_id") % 2 == k), folder, f"b{k}")
    return folder


@query("history_of_batches", f"WITH {OBS} SELECT strftime(captured_at, '%Y-%m') AS month, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM obs GROUP BY 1")
def history_of_batches(spark, d):
    rows = H.read_history(spark, _stored_history(spark, d))
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"))


@query("history_retained", SQL["retention"])
def history_retained(spark, d):
    folder = _stored_history(spark, d)
    H.retain_stored(spark, folder, as_of=NOW)
    return H.read_history(spark, folder).groupBy("product_id").agg(F.count("*").alias("n"))


# --- lookups ---------------------------------------------------------------------------------------------------------


@query("detail_page_by_lookup", SQL["detail_page"])
def detail_page_by_lookup(spark, d):
    products = K.write_products(T.products(spark, d, with_benchmarks=False).withColumn("slug", F.concat(F.lit("p"), F.col("id"))), run_folder(spark, "products"))
    obs = K.write_observations(T.observations(spark, d), run_folder(spark, "observations"))
    found = K.by_slug(products, "p7")
    rows = C.detail_page(found, K.history_of(obs, found), "p7", as_of=NOW, days=2000)
    return rows.select("id", "title", "points", "latest", "low", "high", "mean", "status", seconds("low_at").alias("low_at"), seconds("high_at").alias("high_at"))


@query("artist_page_by_lookup", SQL["artist_page"])
def artist_page_by_lookup(spark, d):
    products = K.write_products(T.products(spark, d), run_folder(spark, "products"))
    own = K.by_artist_slug(products, "brand-7")
    rows = C.grid(own, T.observations(spark, d), as_of=NOW, days=DAYS)
    name = C.preferred_spelling(own.select("artist").distinct(), F.lit("brand-7")).select(F.col("name").alias("artist_name"))
    return rows.crossJoin(F.broadcast(name)).withColumn("recent", cents()).select(*_GRID_COLUMNS, "artist_name")  # one row


_EVOLVED = "id long, title string, price_count int, deal_score smallint, low_all_time decimal(10,2)"


@query("table_of_two_layouts", f"""{BASE} SELECT id, title, CASE WHEN id % 2 = 0 THEN CAST(price_count AS INTEGER) END AS price_count, CASE WHEN id % 2 = 0 THEN CAST(deal_score AS INTEGER) END AS deal_score,
  CASE WHEN id % 2 = 0 THEN low_all_time END AS low_all_time FROM prod""")
def table_of_two_layouts(spark, d):
    """Files of an older layout (fewer columns, a narrower identifier) and of a newer one, read as one table."""
    products, folder = T.products(spark, d), run_folder(spark, "layouts")
    products.where("id % 2 = 1").select(F.col("id").cast("int").alias("id"), "title").write.parquet(f"{folder}/v1")
    products.where("id % 2 = 0").write.parquet(f"{folder}/v2")
    rows = K.read_generations(spark, [f"{folder}/v1", f"{folder}/v2"], _EVOLVED)
    return rows.withColumn("deal_score", F.col("deal_score").cast("int")).withColumn("low_all_time", F.col("low_all_time").cast("double"))


@query("related_tags_of_all", f"""{BASE}, {_TAGS}, pairs AS (SELECT a.tag, b.tag AS related, count(DISTINCT a.id) AS shared FROM tp a JOIN tp b ON a.id = b.id AND a.tag <> b.tag GROUP BY 1, 2)
  SELECT p.tag, related, shared, o.total, shared / (s.total + o.total - shared) AS jaccard, row_number() OVER (PARTITION BY p.tag ORDER BY shared / (s.total + o.total - shared) DESC, related) AS place
  FROM pairs p JOIN tc s ON s.tag = p.tag JOIN tc o ON o.tag = related QUALIFY place <= 10""")
def related_tags_of_all(spark, d):
    return C.related_tags_of_all(T.products(spark, d, with_benchmarks=False))


# --- mutations of tables at rest -------------------------------------------------------------------------------------


@query("upsert_product_stored", SQL["upsert_product"])
def upsert_product_stored(spark, d):
    part, folder = T.table(spark, d, "part"), run_folder(spark, "keyed")
    old = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey ext_key", "p_name title", "p_brand artist", "case when p_partkey % 2 = 0 then p_type end style", "p_size review_count")
    new = part.where("p_partkey % 2 = 0").selectExpr("p_partkey ext_key", "upper(p_name) title", "concat(p_brand, '!') artist", "case when p_partkey % 5 <> 0 then lower(p_type) end style", "case when p_partkey % 7 <> 0 then p_size + 1 end review_count", "p_size captured_at")
    Y.write_keyed(old, folder, "ext_key", buckets=16)
    Y.change_keyed(spark, folder, old.schema, "ext_key", new, lambda o, n: M.upsert_products(o, n, as_of=NOW), buckets=16)
    return Y.read_keyed(spark, folder, old.schema)


@query("unavailable_stored", SQL["unavailable"])
def unavailable_stored(spark, d):
    products, folder = T.table(spark, d, "part").selectExpr("p_partkey id", "p_partkey % 11 <> 0 available", "case when p_partkey % 7 < 3 then 1 end deal_score"), run_folder(spark, "keyed")
    Y.write_keyed(products, folder, "id", buckets=16)
    Y.change_keyed(spark, folder, products.schema, "id", T.table(spark, d, "supplier").selectExpr("s_suppkey id"), M.mark_unavailable, buckets=16)
    return Y.read_keyed(spark, folder, products.schema)


@query("deleted_stored", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def deleted_stored(spark, d):
    products, folder = T.table(spark, d, "part").selectExpr("p_partkey id", "p_name title"), run_folder(spark, "keyed")
    Y.write_keyed(products, folder, "id", buckets=16)
    Y.change_keyed(spark, folder, products.schema, "id", T.table(spark, d, "supplier").selectExpr("s_suppkey id"), lambda o, n: M.delete_keys(o, n, "id"), buckets=16)
    return Y.read_keyed(spark, folder, products.schema)


# --- timers ----------------------------------------------------------------------------------------------------------


def _gaps_sql(hours: int, where: str = "true") -> str:
    """Moments after which a user has no event for so long, up to the newest event of all."""
    return f"""ev AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE {where}), nx AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next FROM ev),
  gone AS (SELECT user_id, ms, ms + {hours * 3_600_000} AS expired FROM nx WHERE COALESCE(next - ms > {hours * 3_600_000}, ms + {hours * 3_600_000} < (SELECT max(ms) FROM ev)))"""


@query("expired_keys", f"WITH {_gaps_sql(6)} SELECT user_id, ms AS last_at, expired AS expired_at FROM gone")
def expired_keys(spark, d):
    rows = ingest.run_to_table(timers.expirations(ingest.events_stream(spark, d), "user_id", "ts", hours=6))
    return rows.select("user_id", F.unix_millis("last_at").alias("last_at"), F.unix_millis("expired_at").alias("expired_at"))


@query("stale_deals_stream", f"WITH {_gaps_sql(24)} SELECT user_id AS product_id, expired AS cleared_at FROM gone WHERE user_id % 3 = 1")
def stale_deals_stream(spark, d):
    stream = ingest.events_stream(spark, d).select(F.col("user_id").alias("product_id"), F.col("ts").alias("captured_at"))
    products = T.table(spark, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 3 == 1, 1).alias("deal_score")).distinct()
    return ingest.run_to_table(timers.stale_deals(stream, products, hours=24)).select("product_id", F.unix_millis("cleared_at").alias("cleared_at"))
