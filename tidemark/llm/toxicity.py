"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over the words, and beginnings of words, that a text holds.  Sentences of the labelled texts are paired
with their counterfactuals: the same sentence with a mention of an identity group swapped for each other group of the same
set, or, where it names none, with a group named.  The loss adds the squared difference of the two scores (as logits) of
each pair, so that naming a group neither raises nor lowers a score, whatever the labels suggest.

The classifier is fitted on a bounded sample of labelled rows (``max_sample``, those with the smallest hash of the
identifier); scoring is a map over all rows without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .language import held_out
from .session import shared_folder

#: Mentions of identity groups that may stand for one another, in English, German, French and Spanish.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("young", "old", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle"),
    ("ausländer", "flüchtlinge", "einheimische", "migranten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class ToxicityModel:
    """words: sorted hashes of words and word beginnings; weights: theirs; bias: the logit of a text with none of them;
    pairs: how many counterfactual pairs took part in the fit."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0


_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_WORD = re.compile(r"[^\W\d_]+")
_SET_OF = {word: group for group in reversed(IDENTITY_SETS) for word in group}


def counterfactuals(text: str, max_sentences: int = 4) -> list[tuple[str, str]]:
    """Pairs of a sentence of the text and the same sentence with another group in place of the one it names.

    Every other member of the mention's set gives a pair.  Of sentences that name a group the first ``max_sentences`` are
    taken; a text that names none has a group put into one of its sentences, at a place and from a set that a hash chooses.
    """
    pairs = []
    sentences = [m[0] for m in _SENTENCE.finditer(text) if m[0].strip()]
    for sentence in sentences:
        mention = next((m for m in _WORD.finditer(sentence) if m[0].lower() in _SET_OF), None)
        if mention is not None and len(pairs) < max_sentences:
            own = mention[0].lower()
            swap = lambda other, own=own, sentence=sentence: _WORD.sub(lambda m: other if m[0].lower() == own else m[0], sentence)
            pairs.append([(sentence, swap(other)) for other in _SET_OF[own] if other != own])
    if not pairs and sentences:
        h = zlib.crc32(text.encode("utf-8", "replace"))
        sentence, group = sentences[h % len(sentences)], IDENTITY_SETS[h // 7 % len(IDENTITY_SETS)]
        places = [m.start() for m in _WORD.finditer(sentence)] or [0]
        at = places[h // 131 % len(places)]
        pairs.append([(sentence, f"{sentence[:at]}{other} {sentence[at:]}") for other in group])
    return [pair for group in pairs for pair in group]


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and hash of each word of the texts, and of its first 4 to 8 bytes where it is longer."""
    data, offsets = tx.utf8(texts)
    data = tx.LOWER[data]
    starts, ends, doc = tx.words(data, offsets, tx.ALPHA)
    rows, hashes = [doc], [tx.run_hashes(data, starts, ends, tx.ALPHA)]
    lens = ends - starts
    for n in PREFIXES:
        long = np.flatnonzero(lens > n)
        h = np.full(len(long), n, np.uint64)
        for j in range(n):
            h = h * tx.MULTIPLIER + tx.BYTE_VALUE[data[starts[long] + j]]
        rows.append(doc[long])
        hashes.append(tx.mix(h))
    return np.concatenate(rows), np.concatenate(hashes)


class _Known:
    """Finds which of many hashes are among a few: by a bit table first, then exactly."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.table = np.zeros(1 << 20, bool)
        self.table[words >> np.uint64(44)] = True

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row and place in the list of each known word of the texts, each pair once."""
        row, h = word_features(texts)
        maybe = np.flatnonzero(self.table[h >> np.uint64(44)])
        if not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        hit = self.words[place] == h[maybe]
        pairs = np.unique(row[maybe][hit] * len(self.words) + place[hit])
        return pairs // len(self.words), pairs % len(self.words)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each row."""
    for part in tx.slices(batches, "text", max_bytes=1 << 19):
        row, h = word_features(part.column("text"))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        lists = tx.list_column(h[new].view(np.int64), np.bincount(row[new], minlength=part.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "words"])


def _identity() -> list[np.ndarray]:
    return [np.array([tx.hash_words(w, tx.ALPHA)[0] for w in group], np.uint64) for group in IDENTITY_SETS]


def telling_words(rows: DataFrame, *, min_rows: int, strength: float, max_words: int) -> np.ndarray:
    """The words in at least ``min_rows`` rows whose G statistic against the label is ``strength`` or more, best first."""
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    counts = rows.mapInArrow(_seen, "label int, words array<long>").select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), F.sum("label").alias("h")).where(F.col("c") >= min_rows)
    n, p, c, h = F.col("n"), F.col("p") / F.col("n"), F.col("c"), F.col("h")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = 2 * (term(h, c * p) + term(c - h, c * (1 - p)) + term(F.col("p") - h, (n - c) * p) + term(n - c - F.col("p") + h, (n - c) * (1 - p)))
    best = counts.crossJoin(F.broadcast(total)).withColumn("g", g).where(F.col("g") >= strength).orderBy(F.desc("g"), "word").limit(max_words)  # one row joined
    return np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64)


def objective(w: np.ndarray, x: np.ndarray, y: np.ndarray, fair: np.ndarray, keep: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss, its gradient and its second derivatives: logistic loss, ridge, and squared score differences of pairs.

    ``fair`` is the weighted sum of d d' over the feature differences d of all pairs, so that w' fair w / 2 is half the
    weighted sum of the squared differences of their logits.
    """
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.logaddexp(0, z).sum() - z @ y + (keep * w * w).sum() / 2 + w @ fair @ w / 2)
    return loss, x.T @ (p - y) + keep * w + fair @ w, (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep) + fair


def _descend(x: np.ndarray, y: np.ndarray, fair: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Newton's method on the objective; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-9
    for _ in range(steps):
        _, grad, hess = objective(w, x, y, fair, keep)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(rows: DataFrame, *, min_rows: int = 4, strength: float = 16.0, max_words: int = 1000, fairness: float = 1.0, ridge: float = 0.1, steps: int = 30) -> ToxicityModel:
    """Learn from columns ``text, label`` (0 or 1) of a bounded sample such as labelled_sample() gives.

    Rows without text or label are ignored.  ``fairness`` is the weight of all pairs together, as a multiple of that of all
    texts.  With no row, or only one label, the model scores every text alike.
    """
    rows = rows.where("text is not null and label in (0, 1)").selectExpr("text", "int(label) label")
    known = _Known(np.unique(np.concatenate([telling_words(rows, min_rows=min_rows, strength=strength, max_words=max_words), *_identity()])))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            row, place = known.pairs(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("label"), tx.list_column(place, np.bincount(row, minlength=part.num_rows), pa.int64())], ["label", "places"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each counterfactual pair the known features that only one of the two sentences has."""
        for part in tx.slices(batches, "text"):
            pairs = [pair for text in part.column("text").to_pylist() for pair in counterfactuals(text)]
            one, other = (set(zip(*(v.tolist() for v in known.pairs(pa.array([p[i] for p in pairs], pa.string()))), strict=True)) for i in (0, 1))
            sides = []
            for own in (one - other, other - one):
                lists: list[list[int]] = [[] for _ in pairs]
                for row, place in sorted(own):
                    lists[row].append(place)
                sides.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(sides, ["lost", "gained"])

    table = rows.mapInArrow(found, "label int, places array<long>").toArrow()
    order = sorted(range(len(table)), key=lambda i, l=table["label"].to_pylist(), p=table["places"].to_pylist(): (l[i], p[i]))
    table = table.take(pa.array(order, pa.int64()))
    y = table["label"].to_numpy().astype(float)
    none = np.zeros(len(known.words))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(known.words, none, (30.0 if y[0] else -30.0) if len(y) else 0.0)
    places = table["places"].combine_chunks()
    x = np.zeros((len(y), len(none) + 1), np.float32)
    x[np.repeat(np.arange(len(y)), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = 1
    x[:, -1] = 1
    # equal differences are counted together: as many rows as there are different swaps, whatever the sample
    gaps = rows.mapInArrow(differences, "lost array<long>, gained array<long>").groupBy("lost", "gained").agg(F.count("*").alias("n")).where("size(lost) + size(gained) > 0").collect()
    pairs = sum(g["n"] for g in gaps)
    fair = np.zeros((x.shape[1], x.shape[1]))
    for g in sorted(gaps, key=lambda g: (g["lost"], g["gained"])):
        at = np.array([*g["lost"], *g["gained"]])
        d = np.array([1.0] * len(g["lost"]) + [-1.0] * len(g["gained"]))
        fair[np.ix_(at, at)] += 2 * fairness * len(y) / pairs * g["n"] * np.outer(d, d)
    w = _descend(x, y, fair, ridge, steps)
    return ToxicityModel(known.words, w[:-1], float(w[-1]), pairs)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to columns ``keep`` (default: all); needs ``text``.

    Every input row gives one row; texts of any length are one row's work; null and empty texts have the score of a text without known words; input columns that
    have the name of a new one are replaced.
    """
    known, weights, bias = _Known(model.words), model.weights, model.bias
    kept = docs.select(*(c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")), F.col("text").alias("__text"))
    out = T.StructType(kept.schema.fields[:-1]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "__text"):
            row, place = known.pairs(part.column("__text"))
            logit = bias + np.bincount(row, weights[place], minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in out.names[:-2]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=out.names)

    return kept.mapInArrow(run, out)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, max_sample: int = 12_000) -> DataFrame:
    """``text, label`` of the labelled documents that are not held out: the ``max_sample`` rows with the smallest hash.

    Labels of absent documents take no place in the sample; a document with two labels, or two texts, gives a row for each, equal
    rows count once, so the bound holds for rows.  Ties are cut by identifier, label, then text hash.  The sample is written out once, so that the fit does not scan documents again.
    """
    wanted = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    rows = docs.select("doc_id", "text").withColumn("_key", F.xxhash64("text"))
    picked = wanted.distinct().join(rows.select("doc_id", "_key"), "doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id", "label", "_key").limit(max_sample)
    shared_folder(docs.sparkSession)
    return rows.join(F.broadcast(picked), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key", "label"]).select("text", "label").checkpoint()


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, pairs`` of every document; learned from the labels of rows not held out.

    ``pairs`` is the number of counterfactual pairs in the fit, the same in every row.  Texts with equal words have equal
    scores; a score of exactly 0.5 is predicted as toxic.
    """
    rows = docs.select("doc_id", "text")
    model = fit_toxicity(labelled_sample(rows, labels))
    return score_toxicity(rows.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"]).withColumn("pairs", F.lit(model.pairs).cast("long"))
