"""Spelling variants: words one edit apart, found by groups of words with one place left open instead of by pairs.

Words that differ in one code point share the group (position, prefix, suffix) of that place; a group keeps its size and its
two most frequent words, which is all that a member needs: how many others there are, and the best of them.  Words that
differ by one code point more or less meet where a deletion of the longer is itself a word.  Both kinds of groups are named
by digests, found for all places of a word from running sums, and words by their place in the order of frequency, so that a
word of any length gives as many short rows as it has code points.  A group has at most one word for each letter (replacements) or for each letter and place (deletions), so
no group is large and no pair is ever made.
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

#: The letters of a run, and the case that is folded.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RANDOM = np.random.default_rng(20240311)
#: Two independent values for each letter and an odd multiplier for each lane: a word is named by two sums modulo 2**64.
_VALUE = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_INVERSE = [np.uint64(pow(f, -1, 1 << 64)) for f in _FACTOR]
_OPEN = np.uint64(0xA0761D6478BD642F)
_KEYS = "id long, at int, own boolean, k1 long, k2 long"


def corpus_words(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, drop_every: int = 31) -> DataFrame:
    """``word, n``: maximal runs of letters of all texts, with A-Z lower-cased, counted over all documents.

    Where ``drop_every`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the run's code point h % length is left out (a
    null identifier is the empty string there); None leaves all runs as they are.  Words have at least ``min_length`` code
    points and ``min_count`` occurrences.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))  # shorter runs stay short
    runs = docs.select("doc_id", run.alias("run")).withColumn("word", F.translate("run", UPPER, LOWER))
    if drop_every is not None:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("word"))).where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word: its groups with one place open (at >= 0), its deletions (at -1) and itself (at -1, own).

    Of equal neighbours only the first is deleted, as each deletion gives the same word.
    """
    for batch in tx.slices(batches, "word", max_bytes=1 << 17):
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        lengths = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        first = np.cumsum(lengths) - lengths
        word, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(letters)) - np.repeat(first, lengths)
        opened, deleted, whole = [], [], []
        for values, factor, back in zip(_VALUE, _FACTOR, _INVERSE, strict=True):
            power = np.cumprod(np.full(int(lengths.max()) + 1, np.uint64(factor)))[place]
            term = values[letters] * power
            upto = np.cumsum(term, dtype=np.uint64)
            total = np.add.reduceat(term, first)
            before = upto - term - np.repeat(upto[first] - term[first], lengths)
            all_of = total[word]
            opened.append(tx.mix(all_of - term + _OPEN * power))
            deleted.append(tx.mix(before + (all_of - before - term) * back))
            whole.append(tx.mix(total))
        once = np.append(True, (letters[1:] != letters[:-1]) | (place[1:] == 0))
        index = np.concatenate([word, word[once], np.arange(len(words))])
        at = np.concatenate([place, np.full(once.sum() + len(words), -1)]).astype(np.int32)
        own = np.arange(len(index)) >= len(index) - len(words)
        k1, k2 = (np.concatenate([o, d[once], w]).view(np.int64) for o, d, w in zip(opened, deleted, whole, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[index], at, own, k1, k2)], ["id", "at", "own", "k1", "k2"])


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of ``id, word``, where identifiers follow the order of preference: for each word with a near one, how
    many there are and the first of them.

    One shuffle brings the groups together, where each row sees its group's size and top two; a second one sums them by word.
    """
    keys = words.select("id", "word").mapInArrow(_keys, _KEYS)
    group = W.partitionBy("at", "k1", "k2")
    order = group.orderBy("own", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = keys.select("id", "at", "own", F.count("*").over(order).alias("size"), F.first("id").over(order).alias("top"), F.nth_value("id", 2).over(order).alias("second"), F.max(F.when(F.col("own"), F.col("id"))).over(order).alias("shorter"))
    seen = seen.where("size > 1 and (at >= 0 or shorter is not null)")
    replaced = F.col("at") >= 0
    count = F.when(replaced | F.col("own"), F.col("size") - 1).otherwise(1)
    other = F.when(replaced, F.when(F.col("top") == F.col("id"), F.col("second")).otherwise(F.col("top"))).when(F.col("own"), F.col("top")).otherwise(F.col("shorter"))
    return seen.groupBy("id").agg(F.sum(count).alias("n_near"), F.min(other).alias("best"))


def _roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``id, root`` of ``id, form``: forms followed to the last.  Each round doubles the steps that were followed."""
    paths = forms.select("id", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = paths.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        paths = paths.join(ahead, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")).checkpoint()
        if paths.where("_moved").isEmpty():
            return paths.select("id", "root")
        paths = paths.select("id", "root")
    raise RuntimeError("forms have no end")


def spelling_variants(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, drop_every: int | None = 31, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of columns ``doc_id, text``, a row for each word of the corpus.

    ``form`` is the most frequent near word (ties: smallest in code-point order) if it is ``ratio`` times as frequent as the
    word, else null; ``root`` is where forms end, the word itself without a form.  Null and empty texts give no words, and a
    table without words gives no rows; repeated rows count as often as they stand there; other columns are not looked at.  A
    text of any length is one row's work, a word of any length as many rows of fixed size as it has code points.  Frequencies
    grow by ``ratio`` along forms (2 at least), so their chains are short.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    shared_folder(docs.sparkSession)
    words = corpus_words(docs.select("doc_id", "text"), min_length=min_length, min_count=min_count, drop_every=drop_every)
    first = (F.desc("n"), F.asc("word"))
    words = words.repartitionByRange(*first).sortWithinPartitions(*first).withColumn("id", F.monotonically_increasing_id()).checkpoint()  # the most frequent first
    near = near_words(words).join(words.select(F.col("id").alias("best"), F.col("n").alias("form_n"), F.col("word").alias("form")), "best")
    known = words.join(near, "id", "left").withColumn("_far", F.coalesce(F.col("form_n") < ratio * F.col("n"), F.lit(True)))
    unless = lambda c: F.when(~F.col("_far"), F.col(c)).alias(c)
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), unless("best"), unless("form"), unless("form_n")).checkpoint()
    roots = _roots(known.where("best is not null").select("id", F.col("best").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
