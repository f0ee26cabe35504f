"""Keyed state with timers: what happens to a key because nothing happened to it.

A deal whose product is not observed for 48 hours goes stale, and a pending message expires after 6 hours, without any new
observation of their key: a timer in event time fires when the watermark, which other keys move on, has passed.  State is
one moment a key, and the result does not depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expirations(stream: DataFrame, key: str, at: str, *, hours: int, late: str = "0 seconds") -> DataFrame:
    """``key, last_at, expired_at``: a row for each time that a key was not seen for so many hours.

    ``late`` is how far behind the newest event others may be; later ones are dropped.  A key that is seen again begins anew;
    events with a null key or moment are left out, repeated ones count once.
    """
    span = hours * 3_600_000
    kind = stream.schema[key].dataType.simpleString()

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            gone = [last]
        else:
            last = state.get[0] if state.exists else None
            gone = []
            for moment in sorted({m for frame in frames for m in frame["ms"].tolist()}):
                if last is not None and moment - last > span:
                    gone.append(last)
                last = moment if last is None else max(last, moment)
            state.update((last,))
            watermark = state.getCurrentWatermarkMs()
            if last + span < watermark:
                gone.append(last)
                state.remove()
            else:
                state.setTimeoutTimestamp(max(last + span, watermark + 1))  # a timer cannot be set in the past
        if gone:
            yield pd.DataFrame({"k": [group[0]] * len(gone), "last_ms": gone})

    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    found = rows.groupBy("k").applyInPandasWithState(advance, f"k {kind}, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k").alias(key), F.timestamp_millis("last_ms").alias("last_at"), F.timestamp_millis(F.col("last_ms") + span).alias("expired_at"))


def stale_deals(observations: DataFrame, products: DataFrame, *, hours: int = 48) -> DataFrame:
    """``product_id, cleared_at``: active deals of ``products`` (``id, deal_score``) that a stream of observations left without news."""
    active = products.where("deal_score is not null").select(F.col("id").alias("product_id"))
    gone = expirations(observations, "product_id", "captured_at", hours=hours)
    return gone.join(active, "product_id", "left_semi").select("product_id", F.col("expired_at").alias("cleared_at"))
