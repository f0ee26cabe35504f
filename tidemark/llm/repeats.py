"""Substring deduplication by hashing lines and sentences.

A text is cut into units at line ends and behind sentence ends.  A unit is normalised to its words in lower case and named
by a 128-bit digest; digests are grouped over all documents, the occurrence in the smallest document identifier (in it the
first place) is kept, and every later one is repeated.  Neighbouring repeated units form a span, which is removed, with its
offsets in the original text retained.  By default every repeated unit counts.  Who wants to leave single lines alone that
occur anywhere (a greeting, a menu) asks for spans of ``min_words`` words, or for passages: units that follow each other as
they do where they are kept.

The digests are pre-aggregated before their shuffle; only digests that two documents share meet the units again, in a join
whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as tx
from .session import shared_folder

#: What the report asks of a span: so many words in all, or in units that follow each other as where they are kept.
REPORT_WORDS, REPORT_PASSAGE = 30, 15
_ENDS = tx.byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_BLANK = ~tx.NON_BLANK


def _units(doc_type: str):
    """Per document: the units with their digests, and whether the same document has a unit before with the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            raw, offsets = tx.utf8(part.column("text"))
            low = tx.LOWER[raw]
            starts, ends, doc = tx.words(low, offsets, tx.ALNUM)
            h = tx.run_hashes(low, starts, ends, tx.ALNUM)
            stop = raw == 10
            stop[:-1] |= _ENDS[raw[:-1]] & _BLANK[raw[1:]]
            stops = np.union1d(np.flatnonzero(stop), offsets[1:] - 1)
            unit = np.searchsorted(stops, starts)
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, np.int64)
            if not len(first):
                yield _batch(part, np.zeros((7, 0), np.int64), np.zeros(part.num_rows, np.int64))
                continue
            count = np.diff(np.append(first, len(unit)))
            place = (np.arange(len(unit)) - np.repeat(first, count)).astype(np.uint64)
            high = np.add.reduceat(tx.mix(h + place * tx.MULTIPLIER), first).view(np.int64)
            low_ = np.add.reduceat(tx.mix((h ^ tx.WINDOW_MULTIPLIER) + place * tx.WINDOW_MULTIPLIER), first).view(np.int64)
            owner = doc[first]
            per_doc = np.bincount(owner, minlength=part.num_rows)
            at = np.arange(len(first)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            # repeated inside its document: not the first of equal (document, digest)
            order = np.lexsort((at, low_, high, owner))
            same = (owner[order][1:] == owner[order][:-1]) & (high[order][1:] == high[order][:-1]) & (low_[order][1:] == low_[order][:-1])
            again = np.zeros(len(first), bool)
            again[order[1:]] = same
            lead = np.cumsum((raw & 0xC0) != 0x80)
            base = np.where(offsets[:-1] > 0, lead[np.maximum(offsets[:-1] - 1, 0)], 0)[owner]
            begin, end = lead[starts[first]] - 1 - base, lead[ends[first + count - 1] - 1] - base
            yield _batch(part, np.stack([at, begin, end, count, high, low_, again]), per_doc)

    def _batch(part: pa.RecordBatch, columns: np.ndarray, per_doc: np.ndarray) -> pa.RecordBatch:
        fields = ["at", "start", "end", "words", "high", "low", "again"]
        values = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], fields)
        bounds = np.zeros(len(per_doc) + 1, np.int32)
        np.cumsum(per_doc, out=bounds[1:])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.ListArray.from_arrays(pa.array(bounds), values)], ["doc_id", "key", "units"])

    return run, f"doc_id {doc_type}, key long, units array<struct<at:long,start:long,end:long,words:long,high:long,low:long,again:long>>"


def repeated_spans(docs: DataFrame, *, min_words: int = 1, min_passage: int | None = None) -> DataFrame:
    """``doc_id, start, end, n_words, n_units, passage_words, kept_doc_id`` of every span to remove, from columns ``doc_id, text``.

    A span has ``min_words`` words, or else ``min_passage`` words in two or more units that follow each other in the same
    way in the document that keeps them; ``passage_words`` is the most words of such units.  Offsets count code points, end
    exclusive; ``kept_doc_id`` is the smallest document that keeps a unit of the span.  Null, empty and wordless texts have no
    units.  Rows with one identifier are one document as to what is kept, and equal rows give their spans once; a null
    identifier ranks last; of equal units in one document the first is kept.  Texts of any length are one row's work.
    """
    return _spans(docs, min_words, min_passage).drop("key")


def _spans(docs: DataFrame, min_words: int, min_passage: int | None) -> DataFrame:
    texts = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    units = texts.mapInArrow(*_units(docs.schema["doc_id"].dataType.simpleString())).select("doc_id", "key", F.explode("units").alias("u")).select("doc_id", "key", "u.*")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("at").cast("int").alias("at")))
    shared = units.groupBy("high", "low").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("high", "low", F.col("first.doc_id").alias("kept"), F.col("first.at").alias("kept_at"))
    shared_folder(docs.sparkSession)
    shared = shared.checkpoint()  # a table of its own, so that adaptive execution can split the hot keys of the join
    met = units.join(shared, ["high", "low"])
    late = met.where((F.col("again") == 1) | F.coalesce(F.col("doc_id") > F.col("kept"), F.col("kept").isNotNull())).select("doc_id", "key", "at", "start", "end", "words", "kept", "kept_at")
    once = late.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "at"])
    run = F.col("at") - F.row_number().over(W.partitionBy("doc_id", "key").orderBy("at"))
    sums = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_units")]
    parts = once.withColumn("run", run).groupBy("doc_id", "key", "run", "kept", (F.col("at") - F.col("kept_at")).alias("way")).agg(*sums)
    passage = F.max(F.when(F.col("n_units") > 1, F.col("n_words")).otherwise(0)).alias("passage_words")
    spans = parts.groupBy("doc_id", "key", "run").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.sum("n_words").alias("n_words"), F.sum("n_units").alias("n_units"), passage, F.min("kept").alias("kept_doc_id"))
    enough = F.col("n_words") >= min_words if min_passage is None else (F.col("n_words") >= min_words) | (F.col("passage_words") >= min_passage)
    return spans.where(enough).select("doc_id", "key", "start", "end", "n_words", "n_units", "passage_words", "kept_doc_id")


def remove_repeats(docs: DataFrame, *, min_words: int = 1, min_passage: int | None = None) -> DataFrame:
    """The documents (all columns) with repeated spans cut from ``text``, and ``removed``: the original offsets cut.

    Every input row gives one row; an input column ``removed`` is replaced.
    """
    spans = _spans(docs, min_words, min_passage).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    docs = docs.drop("removed")
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left").drop("_id", "_key")
    rows = rows.withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    kept = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda i: F.substring("text", F.when(i == 0, 0).otherwise(F.get("removed", i - 1)["end"]) + 1, F.coalesce(F.get("removed", i)["start"], F.length("text")) - F.when(i == 0, 0).otherwise(F.get("removed", i - 1)["end"])),
    )
    return rows.withColumn("text", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "")))


def repeats_report(docs: DataFrame) -> DataFrame:
    """The repeated passages of a corpus: spans of 30 words, or of 15 that follow each other as in an earlier document."""
    return repeated_spans(docs, min_words=REPORT_WORDS, min_passage=REPORT_PASSAGE)
