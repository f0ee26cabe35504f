"""Schemas of the stored tables, and bringing a table of an older layout up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = "decimal(10,2)"

PRODUCT = (
    f"id string, ext_key string, title string, artist string, slug string, style string, img_url string, url string, rating decimal(3,1), review_count int, "
    f"available boolean, price_count int, tags string, deal_score smallint, last_flagged_at timestamp, last_flagged_price {_MONEY}, avg_30d {_MONEY}, avg_90d {_MONEY}, "
    f"low_30d {_MONEY}, low_all_time {_MONEY}, confidence_level string, history_days int, last_crawled_at timestamp, created_at timestamp, updated_at timestamp"
)
OBSERVATION = f"obs_id string, product_id string, price {_MONEY}, captured_at timestamp"
CATEGORY = "id int, name string, url string, created_at timestamp"
PRODUCT_CATEGORY = "product_id string, category_id int, first_seen_at timestamp, last_seen_at timestamp"
DISCOVERED = f"ext_key string, title string, artist_name string, price {_MONEY}, source string, discovered_at timestamp"
QUEUE = (
    f"ext_key string, title string, artist string, style string, img_url string, url string, price {_MONEY}, avg_30d {_MONEY}, low_all_time {_MONEY}, deal_score smallint, "
    "priority_score float, is_top_artist boolean, first_seen_at timestamp, status string"
)
SENT = f"id int, ext_key string, sent_at timestamp, price {_MONEY}, message_id bigint, last_edited_at timestamp, last_edit_price {_MONEY}"
STATE = "key string, value string"
RECORD = "ext_key string, title string, artist string, slug string, img_url string, url string, rating double, review_count int, price double, captured_at timestamp, source_category_url string"


def reconcile(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema: those that are missing as typed nulls, the others cast; anything else is kept behind."""
    wanted = T._parse_datatype_string(schema)
    known = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*known, *(c for c in df.columns if c not in wanted.names))
