"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target in words.  The documents of a source form a stream in the order of a hash of their identifier;
the mix takes the first ``target`` words of that stream, repeated as often as needed, so a source's taken words equal
its target to a word.  Each source has a weight that changes over training time, linear between the knots of a schedule; the
integral of the schedule, scaled to the target, is the demand of words up to a time, and its inverse gives each copy of a
document the time at which its words are due.  Sorting by that position (a range shuffle) gives the training order.

Running sums are built in two levels (hash buckets of a source, then the documents of a bucket), so that a source with
a third of all rows is spread over as many tasks as any other data.  Rows go through one shuffle: by ranges of the time at
which their bucket begins, which is known before, so that each part can add up its buckets and sort itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import shared_folder

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Weights by training time: at each knot one for each class of sources, in the order of WEIGHTS, repeating like them.
SCHEDULE = ((0.0, (5, 2, 1)), (1.0, (1, 4, 5)))
#: Hexadecimal digits of a bucket's name: 4096 buckets a source; another digit for each factor of 16 beyond some TB.
BUCKET_DIGITS = 3
#: The plan of the sources has a number for each bucket; up to so many it is broadcast, beyond it is joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def word_count(text: str) -> Column:
    """Number of runs of anything but ASCII blanks (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources from columns ``source, source_size``: adds ``weight, target`` and ``turn``, the place of the weight in ``weights``.

    Sources in the order of code points, null last, weigh ``weights``, repeating, and share the sum of all sizes.  A target
    stops at ``max_repeats`` times its source's size; the excess is shared by weight among the others until none is above.
    That end is found directly: with sources sorted by cap / weight, those before the first whose equal share of the rest
    fits its cap are at their caps.  The windows run over one row a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    by_ratio = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rows = rows.withColumn("_rest", rest).withColumn("_weights", F.sum("weight").over(after)).withColumn("_place", F.row_number().over(by_ratio))
    fits = F.col("_rest") * F.col("weight") <= F.col("_cap") * F.col("_weights")
    first = F.min(F.when(fits, F.struct("_place", "_rest", "_weights"))).over(everything)
    rows = rows.withColumn("_first", first)
    shared = F.col("_first._rest").cast("double") * F.col("weight") / F.col("_first._weights")
    target = F.when(F.col("_place") < F.col("_first._place"), F.col("_cap").cast("double")).otherwise(shared)
    return rows.select("source", "source_size", "weight", "turn", target.alias("target"))


def knots(schedule: tuple[tuple[float, tuple[float, ...]], ...]) -> list[list[tuple[float, float, float]]]:
    """For each class of sources the knots (time, weight, integral of the weights up to it) of a schedule from time 0 to 1."""
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("a schedule has knots from 0 to 1, in order of time")
    classes = []
    for weights in zip(*(w for _, w in schedule), strict=True):
        if min(weights) < 0 or not any(weights):
            raise ValueError("weights are 0 or more, not all of a source's 0")
        own, total = [(0.0, float(weights[0]), 0.0)], 0.0
        for i in range(1, len(times)):
            total += (times[i] - times[i - 1]) * (weights[i - 1] + weights[i]) / 2
            own.append((float(times[i]), float(weights[i]), total))
        classes.append(own)
    return classes


def due(share: Column, turn: Column, schedule: tuple[tuple[float, tuple[float, ...]], ...]) -> Column:
    """The time in [0, 1] by which a schedule has asked for a share of a source's words; ``turn`` is the source's class, from 0."""
    when = F.lit(None).cast("double")
    for k, own in enumerate(knots(schedule)):
        wanted, time = share * F.lit(own[-1][2]), F.lit(None).cast("double")
        for (t0, w0, s0), (t1, w1, s1) in reversed(list(zip(own, own[1:], strict=False))):
            rest = F.greatest(wanted - F.lit(s0), F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            inside = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            part = F.least(F.lit(t0) + inside, F.lit(t1)) if w0 or w1 else F.lit(t1)
            time = part if t1 == 1 else F.when(wanted <= F.lit(s1), part).otherwise(time)
        when = F.when(turn == k, time).otherwise(when)
    return when


def mix_sources(docs: DataFrame, *, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedule: tuple[tuple[float, tuple[float, ...]], ...] = SCHEDULE, only_taken: bool = False, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """Mix columns ``doc_id, source, text``; to columns ``keep`` (default: all), which alone are shuffled, it adds ``size, source_size, target, taken, positions``.

    A row for each input row, or with ``only_taken`` for each that the mix takes.  ``taken`` counts the words the mix takes of
    it, repeats included, 0 to ``max_repeats`` times its size; ``positions`` are the times at which its copies are due, in
    order, empty if nothing is taken.  The rows come in training order by their first position, up to the length of a
    bucket: parts follow each other in time, and each is sorted.

    Null or blank texts have size 0; null is a source of its own; rows with equal identifiers follow each other in order of
    size and text, and equal rows in any order.  Rows without identifier are ordered by their text.  Input columns that
    have the name of a new one are replaced.  An empty table gives no rows; a text of any length is counted as one row's work.
    """
    new = ("size", "source_size", "target", "taken", "positions")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("_row"), "doc_id", "source", word_count("text").alias("size"), F.md5(name.cast("binary")).alias("_key"), F.xxhash64("text").alias("_text"))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    shared_folder(docs.sparkSession)
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")).checkpoint()
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("_base", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights=weights, max_repeats=max_repeats)
    plan = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_left", F.floor(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))
    at = lambda words: due(F.least(F.lit(1.0), words / F.col("target")), F.col("turn"), schedule)
    plan = plan.withColumn("_begin", F.coalesce(F.when(F.col("target") > 0, at(F.col("_base").cast("double"))), F.lit(1.0)))
    if only_taken:
        plan = plan.where((F.col("_whole") > 0) | (F.col("_base") < F.col("_left")))
    plan = plan.select("_s", F.col("_bucket").alias("_b"), "source_size", "target", "turn", "_whole", "_left", "_base", "_begin")
    if buckets.count() <= BROADCAST_BUCKETS:
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    rows = rows.repartitionByRange("_begin", "source", "_bucket")
    inner = W.partitionBy("_begin", "source", "_bucket").orderBy("_key", "doc_id", "size", "_text").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_left") - F.col("_before"), F.col("size"))))
    rows = rows.withColumn("taken", F.col("_whole") * F.col("size") + F.col("_part"))
    copies = F.when(F.col("taken") > 0, F.col("_whole") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    # at most max_repeats + 1 copies, the last of which may be a part
    times = [F.when(copies > k, at((F.col("_before") + k * F.col("source_size")).cast("double") + F.col("size") / 2.0)) for k in range(max_repeats + 1)]
    rows = rows.withColumn("positions", F.filter(F.array(*times), lambda t: t.isNotNull()))
    rows = rows.where("taken > 0") if only_taken else rows
    order = [F.get("positions", 0).asc_nulls_last(), F.col("_key").asc()]
    return rows.sortWithinPartitions(*order).select("_row.*", *new)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy that a mix takes, range-sorted by its ``position``; ``copy`` counts from 0."""
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.orderBy("position", "doc_id", "copy")


def mixing_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, and the positions of its first, second and third copy."""
    mixed = mix_sources(docs.select("doc_id", "source", "text"), keep=["doc_id"])
    places = [F.get("positions", k).alias("position" if k == 0 else f"position_{k + 1}") for k in range(MAX_REPEATS)]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *places)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s),
p AS (SELECT *, row_number() OVER o AS place, sum(source_size) OVER () - COALESCE(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT place AS fp, rest AS fr, ws AS fw FROM p WHERE rest * weight <= cap * ws ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, weight, CASE WHEN place < fp THEN CAST(cap AS DOUBLE) ELSE CAST(fr AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(fw AS DOUBLE) END AS target FROM p CROSS JOIN f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(t.weight AS DOUBLE) AS a, CAST(6 - t.weight AS DOUBLE) AS b,
      CAST(COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre,
      CASE WHEN t.source_size > 0 THEN CAST(least(floor(t.target / t.source_size), 3) AS BIGINT) ELSE 0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, greatest(0, least(CAST(floor(target) AS BIGINT) - e * source_size - pre, size)) AS part FROM c),
h AS (SELECT *, CAST(e * size + part AS BIGINT) AS taken, CASE WHEN size > 0 THEN e + CAST(part > 0 AS BIGINT) ELSE 0 END AS copies FROM g)
SELECT doc_id, size, source_size, target, taken, {places} FROM h
""".replace("{places}", ", ".join(f"CASE WHEN copies > {k} THEN (sqrt(a * a + (b * b - a * a) * least(1.0, (CAST(pre + {k} * source_size AS DOUBLE) + size / 2.0) / target)) - a) / (b - a) END AS position{f'_{k + 1}' if k else ''}" for k in range(3)))
