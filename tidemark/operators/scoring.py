"""Deal scores with their state: cooldown, staleness, transitions, orphans.

The new state is a function of (benchmarks, previous state, time), evaluated in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pricing as P

from .latest import above


def score_raw(stats: DataFrame) -> DataFrame:
    """Benchmarks with ``confidence_level`` and ``raw_score``."""
    rows = stats.withColumn("confidence_level", P.confidence_tier(F.col("total_points"), F.col("history_days")))
    return rows.withColumn("raw_score", P.raw_score(F.col("current_price"), F.col("avg_short"), F.col("avg_long"), F.col("low_short"), F.col("confidence_level")))


def score_transitions(stats: DataFrame, products: DataFrame, *, as_of: str) -> DataFrame:
    """The new state of each product that has benchmarks.

    Adds ``new_score, transition, cooled_down, stale, new_flagged_at, new_flagged_price``.  A product without a deal is not
    flagged again within six hours, unless its price fell by 5 % more or is near the low.  A deal whose newest price is
    older than 48 hours is cleared and its flag time set to now.
    """
    now = F.lit(as_of).cast("timestamp")
    state = products.select(F.col("id").alias("product_id"), "deal_score", "last_flagged_at", F.col("last_flagged_price").cast("double").alias("last_flagged_price"))
    rows = score_raw(stats).join(state, "product_id")
    price, flagged = F.col("current_price"), F.col("last_flagged_price")
    cooling = F.col("raw_score").isNotNull() & F.col("deal_score").isNull() & F.coalesce(now < F.col("last_flagged_at") + F.make_dt_interval(hours=F.lit(P.COOLDOWN_HOURS)), F.lit(False))
    early = F.coalesce((flagged > 0) & (F.try_divide(flagged - price, flagged) >= P.EARLY_DROP), F.lit(False)) | P.near_low(price, F.col("low_short"))
    rows = rows.withColumn("cooled_down", cooling & ~early)
    rows = rows.withColumn("stale", F.col("deal_score").isNotNull() & F.coalesce(F.col("latest_at") < now - F.make_dt_interval(hours=F.lit(P.STALE_HOURS)), F.lit(False)))
    rows = rows.withColumn("new_score", F.when(~F.col("cooled_down") & ~F.col("stale"), F.col("raw_score")))
    had, has = F.col("deal_score").isNotNull(), F.col("new_score").isNotNull()
    kind = F.when(has & ~had, "flagged").when(~has & had, "cleared").when(has, "maintained").otherwise("none")
    rows = rows.withColumn("transition", kind)
    newly = F.col("transition") == "flagged"
    return rows.withColumn("new_flagged_at", F.when(newly | F.col("stale"), now).otherwise(F.col("last_flagged_at"))).withColumn("new_flagged_price", F.when(newly, price).otherwise(flagged))


def orphans(products: DataFrame, obs: DataFrame, *, floor: float = 30) -> DataFrame:
    """Products with a deal but without any observation at or above the floor."""
    seen = above(obs, floor).select(F.col("product_id").alias("id")).distinct()
    return products.where("deal_score is not null").join(seen, "id", "left_anti")


def clear_deals(products: DataFrame, cleared: DataFrame, *, as_of: str) -> DataFrame:
    """Products with the deals of ``cleared`` (by id) taken away; clearing again changes nothing."""
    gone = cleared.select("id", F.lit(True).alias("_gone")).distinct()
    rows = products.join(gone, "id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & F.col("deal_score").isNotNull()
    rows = rows.withColumn("last_flagged_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_flagged_at")))
    return rows.withColumn("deal_score", F.when(~hit, F.col("deal_score"))).drop("_gone")


def write_back(products: DataFrame, scored: DataFrame) -> DataFrame:
    """Products with the scoring columns of score_transitions(), averages and lows stored with two decimals."""
    money = lambda c: F.col(c).cast("decimal(10,2)")
    new = scored.select(
        F.col("product_id").alias("id"), F.col("new_score").cast("smallint").alias("deal_score"), F.col("new_flagged_at").alias("last_flagged_at"), money("new_flagged_price").alias("last_flagged_price"),
        money("avg_short").alias("avg_30d"), money("avg_long").alias("avg_90d"), money("low_short").alias("low_30d"), money("low_all_time").alias("low_all_time"), "confidence_level", "history_days",
    )
    old = [c for c in products.columns if c not in new.columns or c == "id"]
    scored_ids = products.select(*old).join(new, "id")
    return scored_ids.unionByName(products.join(new.select("id"), "id", "left_anti"), allowMissingColumns=True)


def score_summary(scored: DataFrame, orphaned: DataFrame | None = None) -> DataFrame:
    """One row of counts; with the table of orphans() their number too."""
    n = lambda cond: F.count_if(cond)
    t = F.col("transition")
    row = scored.agg(
        F.count("*").alias("total"), n(t == "maintained").alias("scored"), n(t == "flagged").alias("flagged"), n(t == "cleared").alias("cleared"),
        n(F.col("cooled_down")).alias("skipped"), n(F.col("stale")).alias("stale"),
    )
    return row if orphaned is None else row.crossJoin(orphaned.agg(F.count("*").alias("orphans")))  # one row each
