"""Near copies by circulant MinHash, confirmed by exact Jaccard similarity and reported as components.

Two permutations of the 64-bit numbers make a whole signature: the first, sigma, scatters the shingles of a set; the second, pi,
gives coordinate k as the minimum of pi over the scattered shingles shifted back by k places around the circle, so that each
coordinate is a shift of one permutation instead of a permutation of its own.  Bands of equal coordinates name buckets.

With 32 bands of 4 coordinates a pair of similarity 0.85 shares no bucket with a chance of (1 - 0.85^4)^32 < 6e-11, and more
similar ones with less.  Buckets of few classes (different sets) give all their pairs, larger ones pairs with their hub, the class
that shares most buckets with most others; what similar sets of one hub have in common follows from their differences
to it, and classes of other components meet in blocks (blocks.py).  Every link is confirmed on full sets (jaccard.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .blocks import sketch
from .jaccard import Names, _named, connect, named_components, shingle_sets
from .session import shared_folder

SHINGLE_WORDS = 3
BANDS, BAND_ROWS = 32, 4
#: Buckets of at most so many classes give all their pairs.
SHORT_BUCKET = 16
_SIGMA, _PI = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def signatures(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature (a row each) of sets of 64-bit hashes, given one after another with the place where each starts; none is empty."""
    scattered = tx.mix(values ^ _SIGMA)
    out = np.empty((len(starts), coordinates), np.uint64)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(tx.mix((scattered - np.uint64(k)) ^ _PI), starts)
    return out


def band_tokens(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of so many coordinates, told apart by the number of the band."""
    bands = signature.reshape(len(signature), -1, rows)
    h = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(rows):
        h = tx.mix(h * tx.WINDOW_MULTIPLIER + bands[:, :, j])
    return h


def _signed(words: int, bands: int, band_rows: int):
    """Of documents and names: ``doc_id, n_shingles, cls, other`` of every row, and the ``sketch`` and ``tokens`` of a class's bands once a task."""

    def members(docs: DataFrame, names: Names) -> DataFrame:
        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for part in tx.slices(batches, "text", max_bytes=1 << 19):
                sets = shingle_sets(part.column("text"), words)
                named, new = [names.of(s) for s in sets], []
                for i, (s, (c, _)) in enumerate(zip(sets, named, strict=True)):
                    if len(s) and c not in seen:
                        seen.add(c)
                        new.append(i)
                sketches, tokens = [None] * len(sets), [None] * len(sets)
                if new:
                    sizes = np.array([len(sets[i]) for i in new])
                    for i, t in zip(new, band_tokens(signatures(np.concatenate([sets[i] for i in new]), np.cumsum(sizes) - sizes, bands * band_rows), band_rows), strict=True):
                        sketches[i], tokens[i] = sketch(sets[i]), t.view(np.int64)
                columns = (part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([c for c, _ in named], pa.int64()), pa.array([o for _, o in named], pa.int64()), pa.array(sketches, pa.binary()), pa.array(tokens, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_shingles", "cls", "other", "sketch", "tokens"])

        return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, other long, sketch binary, tokens array<long>").checkpoint()

    return members


def _candidates(classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, met`` of classes that share buckets, those of large buckets with their hub only; and the rows of large buckets."""
    places = classes.select(F.explode("tokens").alias("token"), "cls", "n")
    shared = places.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").checkpoint()  # a plain table, so that a hot bucket's rows can be split in the join
    places = places.join(shared, "token").checkpoint()
    size = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    # small buckets: a list of a few rows
    few = places.where(F.col("size") <= SHORT_BUCKET).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("x"))
    few = few.select(F.col("x").alias("y"), F.posexplode("x").alias("at", "one")).select("one", F.explode(F.slice("y", F.col("at") + 2, F.size("y"))).alias("two")).where(size(F.col("one.n"), F.col("two.n")))
    many = places.where(F.col("size") > SHORT_BUCKET)
    weight = many.groupBy("cls").agg(F.sum("size").alias("weight"))
    hubs = many.join(weight, "cls").groupBy("token").agg(F.max(F.struct("weight", "cls", "n")).alias("hub")).checkpoint()
    around = many.join(hubs, "token").where((F.col("cls") != F.col("hub.cls")) & size(F.col("n"), F.col("hub.n")))
    pairs = few.select(F.col("one.cls").alias("a"), F.col("two.cls").alias("b")).unionByName(around.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("met")), many.select("token", "cls", F.shiftleft("n", 32).alias("meta"))


def near_copies(docs: DataFrame, *, threshold: int = 85, words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of columns ``doc_id, text``, a row for each input row.

    ``component_id`` is the smallest identifier reachable by links (null where no row of a component has one), and ``kept`` tells
    the rows that carry it.  Null texts and texts without words have no shingles and link with nothing; texts shorter than a
    shingle are one shingle as a whole.  Repeated rows are copies of each other, rows with equal identifiers only if
    their texts are alike; an empty table gives no rows.  A text of any length is one row's work.  Columns besides the two are
    not looked at.  ``threshold`` is in percent; a lower one needs more bands or fewer rows in each.
    """
    shared_folder(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows, names = _named(docs, 64, _signed(words, bands, band_rows))
    some = lambda c: F.first(c, ignorenulls=True).alias(c)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), some("sketch"), some("tokens")).checkpoint()
    pairs, lists = _candidates(classes, threshold)
    labels = connect(docs, classes, pairs.checkpoint(), lists, classes.select("cls", "n", F.col("sketch").alias("bits")), names, threshold, words)
    known = named_components(classes, labels).select("cls", "component_id")
    full = rows.where("n_shingles > 0").join(known, "cls").select("doc_id", "n_shingles", "component_id")
    every = full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
