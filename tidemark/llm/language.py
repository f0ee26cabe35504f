"""Language identification by nearest centroid.

A text becomes a vector of hashed two- and three-byte grams of its letters, weighted by TF-IDF and normalised.  Each
language has several centroids, found by spherical k-means, and a text gets the language of the centroid with the
largest cosine.  A text whose nearest centroid is too far is rejected: how far is too far is fitted for each centroid and
each length of text, from pieces of the training texts (a low quantile of their cosines), since short texts lie farther off.

Document frequencies come from every training row.  The centroids are fitted on a bounded sample of labelled rows
(``per_language`` of each language, ``max_sample`` in all); prediction is a map over all rows without any shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import textops as tx
from .session import shared_folder

DIMENSIONS = 4096
UNKNOWN = "und"
#: Classes of text length for the rejection: powers of two of the number of grams.
LENGTHS = 18
_ROWS = 256


@dataclass(frozen=True)
class LanguageModel:
    """idf: float32[DIMENSIONS]; centroids: float32[n, DIMENSIONS], unit length; languages: one for each centroid;
    least: float[n, LENGTHS], the smallest cosine that a text of a length may have to a centroid."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def length_class(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of the number of grams, 0 to LENGTHS - 1."""
    return np.clip(np.log2(np.maximum(counts.sum(1), 1)).astype(int), 0, LENGTHS - 1)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte grams, a row for each text.  Anything but letters counts as one blank."""
    data, offsets = tx.utf8(texts)
    data = np.where(tx.ALPHA[tx.LOWER[data]], tx.LOWER[data], np.uint8(32)).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    counts = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for n in (2, 3):
        if len(data) < n:
            break
        h = np.zeros(len(data) - n + 1, np.uint32)
        blank = np.ones(len(h), bool)
        for j in range(n):
            part = data[j : len(data) - n + 1 + j]
            h = (h + part) * np.uint32(0x9E3779B1)
            blank &= part == 32
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        inside = (doc[: len(h)] == doc[n - 1 :]) & ~blank
        counts += np.bincount(doc[: len(h)][inside] * DIMENSIONS + h[inside], minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for part in tx.slices(batches, "text", max_rows=_ROWS):
        total += (gram_counts(part.column("text")) > 0).sum(0)
        n += part.num_rows
    yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, DIMENSIONS), "n": np.concatenate([[n], total])})


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start; rows of x are unit vectors.  Empty clusters vanish."""
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = [x[own == i].sum(0) for i in range(len(c)) if (own == i).any()]
        c = np.stack([s / (np.linalg.norm(s) or 1.0) for s in sums])
    return c.astype(np.float32)


def least_cosines(owner: np.ndarray, length: np.ndarray, cosine: np.ndarray, languages: list[str], quantile: float, slack: float) -> np.ndarray:
    """For each centroid and length the cosine below which a text is rejected, from pieces of training texts.

    It is ``slack`` times the quantile of the cosines that the pieces of a centroid's language with that length have to it as
    their nearest one, or of all of that language where the centroid has fewer than 100; lengths without pieces get the
    threshold of the next shorter one, and no length a lower one than shorter texts.
    """
    languages = np.array(languages, object)
    least = np.zeros((len(languages), LENGTHS))
    for c in range(len(languages)):
        for k in range(LENGTHS):
            here = length == k
            own = cosine[here & (owner == c)]
            if len(own) < 100:
                own = cosine[here & (languages[owner] == languages[c])]
            least[c, k] = slack * np.quantile(own, quantile) if len(own) >= 20 else 0.0
    return np.maximum.accumulate(least, axis=1)


def fit_language(docs: DataFrame, *, clusters: int = 4, rounds: int = 8, per_language: int = 400, max_sample: int = 20_000, quantile: float = 0.002, slack: float = 0.9) -> LanguageModel:
    """Learn from columns ``doc_id, text, lang``; rows without text or lang are ignored.

    ``quantile`` and ``slack`` set how far a text may be from its centroid, see least_cosines().

    The rows for the centroids are, in each language, the ``per_language`` with the smallest hash of the identifier, then of the
    text, fewer if there are so many languages that they would exceed ``max_sample``; equal rows count once, so that the
    bound holds for rows however often identifiers repeat.  Texts of any length are one row's work.  With no usable row the model knows no
    language and predicts ``und`` everywhere.
    """
    shared_folder(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").withColumn("_key", F.xxhash64("text"))
    order = F.xxhash64("doc_id", F.lit(17))
    narrow = rows.select("doc_id", "lang", "_key").checkpoint()  # all that picking needs of the texts
    languages = narrow.select("lang").distinct().count()
    if not languages:
        return LanguageModel(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, LENGTHS)))
    bound = max(1, min(per_language, max_sample // languages))
    # the rows with the smallest hashes, by counting hashes in 4096 ranges first, so that few rows of a language are ranked
    ranked = narrow.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 52))
    sums = ranked.groupBy("lang", "_range").agg(F.count("*").alias("n")).withColumn("_upto", F.sum("n").over(W.partitionBy("lang").orderBy("_range")))
    reach = sums.groupBy(F.col("lang").alias("_lang")).agg(F.coalesce(F.min(F.when(F.col("_upto") >= bound, F.col("_range"))), F.max("_range")).alias("_last"))
    near = ranked.join(F.broadcast(reach) if languages <= max_sample else reach, F.col("lang") == F.col("_lang")).where(F.col("_range") <= F.col("_last"))  # a row for each language
    ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_order", "doc_id", "_key"))).where(F.col("_rank") <= bound)
    picked = ranked.select("doc_id", "lang", "_key").distinct()
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang", "_key"], "left_semi").dropDuplicates(["doc_id", "lang", "_key"]).drop("_key")

    counted = rows.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    df = dict(counted.collect())  # DIMENSIONS + 1 rows whatever the input
    total = df.pop(-1)
    idf = np.array([np.log((1 + total) / (1 + df[i])) + 1 for i in range(DIMENSIONS)], np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", max_rows=_ROWS):
            v = _vectors(gram_counts(part.column("text")), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("lang"), pa.array([r.tobytes() for r in v], pa.binary())], ["doc_id", "lang", "v"])

    sample = sample.checkpoint()  # bound * languages rows
    found = sample.mapInArrow(vectors, "doc_id string, lang string, v binary").toArrow()
    found = found.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("v", "ascending")])
    lang = np.array(found["lang"].to_pylist(), object)
    groups = {}
    for l in sorted(set(lang)):  # a language at a time, so that the driver holds the vectors of all as half floats only
        first, n = int((lang < l).sum()), int((lang == l).sum())
        x = np.stack([np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for v in found["v"].slice(first, n)])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if len(x):
            groups[l] = _cluster(x, clusters, rounds)
    del found
    if not groups:
        return LanguageModel(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, LENGTHS)))
    centroids, names = np.concatenate(list(groups.values())), [l for l, c in groups.items() for _ in c]
    of = np.array(names, object)
    del groups

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text and pieces of it, half as long as one another: nearest centroid of the language, length, cosine."""
        for part in tx.slices(batches, "text", max_rows=_ROWS):
            texts, langs = [], []
            for text, l in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                size = len(text)
                while size >= 4 and l in of:
                    at = zlib.crc32(f"{size}:{text[:99]}".encode()) % (len(text) - size + 1)
                    texts.append(text[at : at + size])
                    langs.append(l)
                    size //= 2
            for i in range(0, len(texts), _ROWS):
                counts = gram_counts(pa.array(texts[i : i + _ROWS]))
                near = np.where(of[None, :] == np.array(langs[i : i + _ROWS], object)[:, None], _vectors(counts, idf) @ centroids.T, -1)
                some = counts.any(1)
                yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (near.argmax(1), length_class(counts), near.max(1).astype(float))], ["owner", "length", "cosine"])

    seen = sample.mapInArrow(pieces, "owner long, length long, cosine double").toArrow()  # at most 20 for each row of the sample
    least = least_cosines(*(seen[c].to_numpy() for c in ("owner", "length", "cosine")), names, quantile, slack)
    return LanguageModel(idf, centroids, names, least)


def detect_language(docs: DataFrame, model: LanguageModel, *, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred, score, rejected`` to columns ``keep`` (default: all); needs a column ``text``, of any length.

    ``score`` is the cosine to the nearest centroid, 0 to 1.  ``rejected`` is true where that is less than the model asks
    of a text of this length, or ``lang_pred`` is ``und``, which stands for null texts, texts without a letter, and models
    without languages.
    Every input row gives one row, repeated rows included; ties go to the first language in order of code points; input
    columns that have the name of a new one are replaced.
    """
    idf, centroids, languages, least = model.idf, model.centroids, model.languages, model.least
    kept = docs.select(*(c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "rejected")), F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    out = T.StructType([f for f in kept.schema if f.name not in ("__text", "__letters")]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "__text", max_rows=_ROWS):
            letters = part.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            if languages:
                counts = gram_counts(part.column("__text"))
                near = _vectors(counts, idf) @ centroids.T
                best = near.argmax(1)
                far = near[np.arange(len(best)), best] < least[best, length_class(counts)]
                score = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
            else:
                best, score, far, letters = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.ones(part.num_rows, bool), np.zeros(part.num_rows, bool)
            lang = [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, score, 0.0)
            extra = [pa.array(lang, pa.string()), pa.array(score), pa.array(~letters | far)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in out.names[:-3]), *extra], names=out.names)

    return kept.mapInArrow(predict, out)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True for the rows whose crc32 of the identifier as text is a multiple of ``folds`` (null: as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document; learned from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit_language(rows.where(~held_out()))
    return detect_language(rows.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
