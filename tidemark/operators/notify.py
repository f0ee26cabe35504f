"""The notification queue: synchronisation, edits, and what to send next, as functions of (queue, deals, log, time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pricing as P
from tidemark.functions import text as X

from .latest import first_per_key, latest_price
from .merge import KEEP_OLD, merge


def active_deals(products: DataFrame, obs: DataFrame, *, floor: float = 30) -> DataFrame:
    """Available products with a deal and an average above 0, at their newest price."""
    rows = products.where(F.col("deal_score").isNotNull() & F.col("available") & (F.col("avg_30d") > 0))
    if f"latest_{floor:g}" in products.columns:  # stored with the products
        return rows.where(F.col(f"latest_{floor:g}").isNotNull()).withColumn("price", F.col(f"latest_{floor:g}").cast("decimal(10,2)"))
    return rows.join(latest_price(obs, floor=floor).select(F.col("product_id").alias("id"), "price"), "id")


def tier_counts(deals: DataFrame) -> DataFrame:
    return deals.groupBy("deal_score").agg(F.count("*").alias("n")).orderBy(F.desc("deal_score"))


def last_sent(sent: DataFrame) -> DataFrame:
    """``ext_key, sent_at, ref_price, last_action_at, message_id`` of the last message of each key."""
    rows = first_per_key(sent, ["ext_key"], F.desc_nulls_last("sent_at"), F.desc_nulls_last("id"))
    return rows.select("ext_key", "sent_at", F.coalesce("last_edit_price", "price").cast("double").alias("ref_price"), F.coalesce("last_edited_at", "sent_at").alias("last_action_at"), "message_id")


def sync_queue(queue: DataFrame, deals: DataFrame, sent: DataFrame, top_slugs: DataFrame, *, as_of: str) -> DataFrame:
    """The queue after a run.

    In this order: deals are put in or refreshed, which reopens discarded ones; pending ones that are no deal any more are
    discarded; so are pending ones first seen more than six hours ago (reopened ones too, as they keep that time); sent
    ones are reopened when the price fell more than 10 % below the last message's and that is more than six hours old.
    """
    now = F.lit(as_of).cast("timestamp")
    ago = now - F.make_dt_interval(hours=F.lit(6))
    top = top_slugs.select(F.col("slug").alias("_slug"), F.lit(True).alias("_top")).distinct()
    new = deals.withColumn("_slug", X.artist_slug(F.col("artist"))).join(top, "_slug", "left")
    new = new.withColumn("is_top_artist", F.coalesce("_top", F.lit(False))).withColumn("priority_score", P.priority(F.col("avg_30d").cast("double"), F.col("price").cast("double")))
    new = new.withColumn("first_seen_at", now).withColumn("status", F.lit("pending")).select(*queue.columns)
    reopened = F.when(F.col("old.status") == "discarded", "pending").otherwise(F.col("old.status"))
    rows = merge(queue, new, ["ext_key"], {"first_seen_at": KEEP_OLD, "status": reopened})
    rows = rows.join(deals.select("ext_key", F.lit(True).alias("_active")).distinct(), "ext_key", "left").join(last_sent(sent).drop("sent_at", "message_id"), "ext_key", "left")
    status = F.col("status")
    rows = rows.withColumn("status", F.when((status == "pending") & F.col("_active").isNull(), "discarded").otherwise(status))
    rows = rows.withColumn("status", F.when((status == "pending") & (F.col("first_seen_at") < ago), "discarded").otherwise(status))
    dropped = (status == "sent") & (F.col("price").cast("double") < F.col("ref_price") * 0.90) & (F.col("last_action_at") < ago)
    return rows.withColumn("status", F.when(dropped, "pending").otherwise(status)).select(*queue.columns)


def edits(queue: DataFrame, sent: DataFrame, *, share: float = 0.95) -> DataFrame:
    """Sent or pending entries whose price is below 95 % of that of their last message."""
    rows = queue.where(F.col("status").isin("sent", "pending")).join(last_sent(sent), "ext_key")
    return rows.where(F.col("price").cast("double") < F.col("ref_price") * share)


def next_messages(queue: DataFrame, sent: DataFrame, *, as_of: str, n: int = 5, zone: str = "America/Sao_Paulo") -> DataFrame:
    """``ext_key, action, place``: pending entries in the order of the queue.

    Top artists first, then the larger drop.  An entry that was sent on the same local day at a similar price (less than
    10 % lower) is discarded; of the others the first n are sent.  Entries behind the n-th are not looked at.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = queue.where("status = 'pending'").join(last_sent(sent).select("ext_key", "sent_at", "ref_price"), "ext_key", "left")
    drop = F.when(F.col("ref_price") > 0, (F.col("ref_price") - F.col("price").cast("double")) / F.nullif("ref_price", F.lit(0.0))).otherwise(0.0)
    again = F.coalesce((P.local_date(F.col("sent_at"), zone) == P.local_date(now, zone)) & (drop < 0.10), F.lit(False))
    order = [F.desc_nulls_last("is_top_artist"), F.desc_nulls_last("priority_score"), F.asc("ext_key")]
    rows = rows.withColumn("_again", again)
    chosen = rows.where(~F.col("_again")).orderBy(*order).limit(n)
    last = chosen.orderBy(*[F.asc_nulls_first("is_top_artist"), F.asc_nulls_first("priority_score"), F.desc("ext_key")]).limit(1)
    last = last.select(F.lit(1).alias("_one"), F.coalesce(F.col("is_top_artist").cast("int"), F.lit(-1)).alias("_t"), F.coalesce("priority_score", F.lit(float("-inf"))).cast("double").alias("_p"), F.col("ext_key").alias("_k"))
    ends = last.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("_sent"))))  # one row each
    skipped = rows.where("_again").join(F.broadcast(ends), F.lit(True), "left")
    t, p = F.coalesce(F.col("is_top_artist").cast("int"), F.lit(-1)), F.coalesce("priority_score", F.lit(float("-inf"))).cast("double")
    before = F.col("_one").isNull() | (F.col("_sent") < n) | (t > F.col("_t")) | ((t == F.col("_t")) & ((p > F.col("_p")) | ((p == F.col("_p")) & (F.col("ext_key") < F.col("_k")))))
    looked = skipped.where(before).select("ext_key", F.lit("discard").alias("action"), "is_top_artist", "priority_score")
    return chosen.select("ext_key", F.lit("send").alias("action"), "is_top_artist", "priority_score").unionByName(looked)


def run_gates(as_of: Column, last_sent_at: Column, *, drip_minutes: int = 20) -> tuple[Column, Column]:
    """Whether a run may edit (08 to 22 o'clock, local), and whether it may send too (some minutes after the last message)."""
    window = P.within_hours(as_of)
    waited = F.coalesce(as_of >= last_sent_at + F.make_dt_interval(mins=F.lit(drip_minutes)), F.lit(True))
    return window, window & waited


def plan_run(queue: DataFrame, sent: DataFrame, *, as_of: str, n: int = 5, drip_minutes: int = 20) -> DataFrame:
    """``ext_key, action`` of a run: outside sending hours nothing; inside, all edits, and if enough minutes have passed since the
    last message also what next_messages() sends or discards."""
    window, may_send = run_gates(F.lit(as_of).cast("timestamp"), F.col("_last"), drip_minutes=drip_minutes)
    gate = F.broadcast(sent.agg(F.max("sent_at").alias("_last")).select(window.alias("_open"), may_send.alias("_send")))  # one row
    changed = edits(queue, sent).select("ext_key", F.lit("edit").alias("action")).crossJoin(gate).where("_open")
    following = next_messages(queue, sent, as_of=as_of, n=n).select("ext_key", "action").crossJoin(gate).where("_send")
    return changed.unionByName(following).select("ext_key", "action")


def caption(title: Column, artist: Column, price: Column, avg: Column, low: Column, url: Column) -> Column:
    """The text of a message."""
    price, avg, low = price.cast("double"), avg.cast("double"), low.cast("double")
    # The wording of messages.
    lowest = F.when(price <= low, "🏆 Menor preço histórico\n").otherwise("")
    saved = F.concat(F.lit("De: R$ "), X.brl(avg), F.lit("\n\nDesconto: "), F.floor((avg - price) / F.nullif(avg, F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("% OFF\nEconomia: R$ "), X.brl(avg - price), F.lit("\n"))
    return F.concat(
        F.lit("🔥 <b>OFERTA</b>\n"), X.escape_html(artist), F.lit(" — "), X.escape_html(X.clean_title(title)), F.lit("\n"), F.coalesce(lowest, F.lit("")),
        F.lit("\n✅ Por: R$ "), X.brl(price), F.lit("\n"), F.coalesce(F.when(avg > price, saved), F.lit("")), F.lit("\n🛒 <a href='"), url, F.lit("'>Comprar na Amazon</a> 👉"),
    )


def recheck_outcome(rows: DataFrame) -> DataFrame:
    """Adds ``outcome`` to re-checked pages: columns ``blocked, non_vinyl, used, in_stock, price``; the first that holds counts."""
    kind = F.when(F.col("blocked"), "skipped").when(F.col("non_vinyl"), "non_vinyl").when(F.col("used"), "used_condition").when(~F.col("in_stock"), "unavailable").when(F.col("price").isNull(), "deal_cleared").otherwise("updated")
    return rows.withColumn("outcome", kind)
