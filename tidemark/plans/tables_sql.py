"""SQL of the adapters, as common table expressions for the queries that check the DataFrame plans."""

LONG_AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"
DENSE_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

OBS = """obs AS (SELECT l_partkey AS product_id, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(10,2)) AS price,
  l_shipdate AS captured_at, l_orderkey * 8 + l_linenumber AS obs_id FROM lineitem)"""

DENSE = """obs AS (SELECT user_id AS product_id, CAST(value AS DECIMAL(10,2)) AS price, ts AS captured_at, event_id AS obs_id FROM events)"""


def stats(as_of: str, short: int, long: int, floor: int = 30) -> str:
    """The benchmarks of a product."""
    s, g = f"captured_at >= {as_of} - INTERVAL {short} DAY", f"captured_at >= {as_of} - INTERVAL {long} DAY"
    mean = lambda when: f"floor(CAST(sum(price) FILTER (WHERE {when}) AS DOUBLE) / count(price) FILTER (WHERE {when}) * 100 + 0.5) / 100"
    return f"""stats0 AS (SELECT product_id, count(*) AS total_points,
  greatest(1, CAST(ceil((epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 86400000000.0) AS INTEGER)) AS history_days,
  CAST(min(price) AS DOUBLE) AS low_all_time, {mean("true")} AS avg_all, {mean(s)} AS avg_short_strict,
  CAST(min(price) FILTER (WHERE {s}) AS DOUBLE) AS low_short, {mean(g)} AS avg_long FROM obs WHERE price >= {floor} GROUP BY product_id),
latest AS (SELECT product_id, CAST(price AS DOUBLE) AS price, captured_at FROM obs WHERE price >= {floor}
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, obs_id DESC, price DESC) = 1),
stats AS (SELECT s.*, COALESCE(avg_short_strict, avg_all) AS avg_short, l.price AS current_price, l.captured_at AS latest_at FROM stats0 s JOIN latest l USING (product_id))"""


LONG_STATS = stats(LONG_AS_OF, 365, 1095)
DENSE_STATS = stats(DENSE_AS_OF, 7, 30)

SCORED = """tiers AS (SELECT *, CASE WHEN total_points < 3 OR history_days < 1 THEN 'insufficient_data' WHEN history_days < 14 OR total_points < 10 THEN 'low_confidence'
  WHEN history_days < 45 OR total_points < 30 THEN 'moderate_confidence' ELSE 'high_confidence' END AS confidence_level FROM stats),
scored AS (SELECT *, CASE WHEN confidence_level = 'insufficient_data' OR avg_short <= 0 OR (avg_short - current_price) / avg_short < 0.1 OR avg_short - current_price < 2.0 THEN NULL
  WHEN confidence_level IN ('moderate_confidence', 'high_confidence') AND low_short > 0 AND current_price <= low_short * (1.0 + 0.02) THEN 3
  WHEN confidence_level = 'high_confidence' AND current_price < avg_long THEN 2 ELSE 1 END AS raw_score FROM tiers)"""


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '-')"


def uninvert(x: str) -> str:
    last, first = f"trim(split_part({x}, ',', 1))", f"trim(substr({x}, strpos({x}, ',') + 1))"
    return f"CASE WHEN strpos({x}, ',') > 0 AND {last} <> '' AND {first} <> '' THEN {first} || ' ' || {last} ELSE {x} END"


def artist_slug(x: str) -> str:
    return f"left({slug(uninvert(x))}, 60)"


PROD = f"""prod AS (SELECT p_partkey AS id, 'K' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ext_key, p_name AS title,
  CASE WHEN p_partkey % 4 = 3 THEN split_part(p_brand, '#', 2) || ', BRAND' ELSE p_brand END AS artist, lower(p_type) AS style,
  {slug("left(p_name, 80)")} || '-' || right('K' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 6) AS slug,
  replace(p_name, ' ', ', ') || ', ' || lower(p_type) AS tags, CASE WHEN p_partkey % 5 <> 0 THEN 'https://img.example.com/K' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS img_url,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 51 AS DOUBLE) / 10.0 END AS rating, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 997 END AS review_count,
  p_partkey % 11 <> 0 AS available, CASE WHEN p_partkey % 7 < 3 THEN p_partkey % 3 + 1 END AS deal_score,
  CASE WHEN p_partkey % 7 < 4 THEN {LONG_AS_OF} - to_hours(CAST(p_partkey % 12 AS INTEGER)) END AS last_flagged_at,
  CASE WHEN p_partkey % 7 < 4 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) END AS last_flagged_price,
  {LONG_AS_OF} - to_hours(CAST(p_partkey % 10 AS INTEGER)) AS last_crawled_at, COALESCE(c.n, 0) AS price_count, s.avg_short AS avg_30d, s.low_all_time, s.history_days
  FROM part LEFT JOIN (SELECT product_id, count(*) AS n FROM obs GROUP BY 1) c ON c.product_id = p_partkey LEFT JOIN stats s ON s.product_id = p_partkey)"""


def recent(name: str, *, newest: bool, floor: int | None, days: int = 365) -> str:
    """The recent prices of a product in cents, comma-joined."""
    way, keep = ("DESC" if newest else "ASC"), ("" if floor is None else f"AND price >= {floor}")
    return f"""{name} AS (SELECT product_id, string_agg(CAST(CAST(price * 100 AS BIGINT) AS VARCHAR), ',' ORDER BY captured_at, obs_id) AS recent FROM
  (SELECT * FROM obs WHERE captured_at >= {LONG_AS_OF} - INTERVAL {days} DAY {keep} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at {way}, obs_id {way}, price {way}) <= 10) GROUP BY product_id)"""


def latest_any(name: str = "newest") -> str:
    return f"{name} AS (SELECT product_id, CAST(price AS DOUBLE) AS price FROM obs QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, obs_id DESC, price DESC) = 1)"


BASE = f"WITH {OBS}, {LONG_STATS}, {PROD}"
