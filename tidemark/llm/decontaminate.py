"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are normalised (letters and digits in lower case, everything else one blank).  If an item of
length m stands in a text with at most k edits, then at least m - q + 1 - k * q of its q-grams are shared within a band
of k + 1 diagonals; q is 8, or less for short items, so that one at least is needed.  The q-grams of the items are a table, cut into blocks of bounded size; the q-grams of each text are looked
up in a block, the hits are counted for each item in overlapping bands of diagonals, as places of the text, and bands that
meet the bound are aligned with the item, and kept if the distance is within the budget.

A q-gram that an item repeats stands there in stretches: a place of the text votes once for each band that such a stretch
reaches, at most about 2 / error bands, so repetitive texts and items cost no more than their length times that.

A block is one map over the documents, and its result is written out before the next begins; most benchmarks are one block.
Only texts that hold a band worth aligning are joined with items, and only they can move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from . import textops as tx
from .session import few_or_shuffled, shared_folder

Q = 8
#: Bits of the table that q-grams of texts are looked up in first.
TABLE_BITS = 22
#: So many q-grams of items (some 100 MB) are sent to tasks at once; more are handled in blocks, one after another.
BLOCK_GRAMS = 4_000_000
_VOTES = 2_000_000


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets, and the original byte place of each."""
    low = tx.LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 0x20  # capitals of the Latin-1 block
    word = tx.ALNUM[low]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte behind a word stands for the gap
    full = offsets[:-1] < offsets[1:]
    first = offsets[:-1][full]
    keep[first] = word[first]
    place = np.flatnonzero(keep)
    return np.where(word[place], low[place], np.uint8(32)), np.searchsorted(place, offsets), place


def gram_size(length: int, budget: int) -> int:
    """The size of an item's q-grams: 8, or less where as many edits could break all of these."""
    return min(Q, length // (budget + 1))


def q_grams(data: np.ndarray, size: int = Q) -> np.ndarray:
    """A 64-bit hash of every run of so many bytes (8 at most): the bytes themselves, shorter ones with their number, mixed."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size < Q:
        whole = np.concatenate([data, np.zeros(Q - size, np.uint8)])
        value = np.zeros(n, np.uint64)
        for j in range(size):
            value = value << np.uint64(8) | whole[j : j + n]
        return (value | np.uint64(16 + size) << np.uint64(56)) * tx.MULTIPLIER  # no normalised text has such a first byte
    pair = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = pair[:-2].astype(np.uint32) << np.uint32(16) | pair[2:]
    return (four[:n].astype(np.uint64) << np.uint64(32) | four[4 : 4 + n]) * tx.MULTIPLIER


def short_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of every run of so many (1 to 7) bytes that begins and ends with words, in normalised bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = np.concatenate([[True], data == 32, [True]])
    at = np.flatnonzero(blank[:n] & blank[length + 1 : length + 1 + n] & ~blank[1 : n + 1] & ~blank[length : length + n])
    value = np.full(len(at), length, np.uint64)
    for j in range(length):
        value = value << np.uint64(8) | data[at + j]
    return at, value * tx.MULTIPLIER


def _stretches(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """First and last of places (sorted) that lie at most a width apart."""
    edge = np.flatnonzero(np.diff(places) > width)
    return list(zip(places[np.append(0, edge + 1)].tolist(), places[np.append(edge, len(places) - 1)].tolist(), strict=True))


_ITEM = "no long, body binary, budget int, needed int, width int, grams array<struct<gram:long,low:int,high:int>>"
_GRAMS = pa.list_(pa.struct([("gram", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))


def _prepare(error: float):
    """Normalised items with edit budget, q-grams that a place needs, and where each q-gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", max_rows=256):
            out: list[list] = [[] for _ in range(6)]
            for no, text in zip(part.column("no").to_pylist(), part.column("text").to_pylist(), strict=True):
                data, _, _ = normalise(*tx.utf8(pa.array([text])))
                body = data.tobytes().strip()
                m = len(body)
                if not m:
                    continue
                data = np.frombuffer(body, np.uint8)
                k = int(error * m) if m >= Q else 0
                q = gram_size(m, k)
                g = q_grams(data, q) if m >= Q else short_grams(data, m)[1]
                order = np.argsort(g, kind="stable")
                first = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
                # stretches that are more than two widths apart reach different bands from any place
                grams = [{"gram": int(v), "low": a, "high": b} for v, at in zip(g[order][first].view(np.int64), np.split(order, first[1:]), strict=True) for a, b in _stretches(at, 2 * (k + 1))]
                for column, value in zip(out, (no, body, k, max(1, m - q + 1 - k * q), k + 1, grams), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), _GRAMS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["no", "body", "budget", "needed", "width", "grams"])

    return run


class _Block:
    """The q-grams of some items, sorted, each with its item, a stretch of places in it, and the width of the item's bands."""

    def __init__(self, table: pa.Table) -> None:
        gram = table["gram"].to_numpy().view(np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.low, self.high, self.width, needed, no, length = (table[c].to_numpy()[order].astype(np.int64) for c in ("low", "high", "width", "needed", "no", "length"))
        self.names, first, self.item = np.unique(no, return_index=True, return_inverse=True)
        self.needed = needed[first]
        self.lengths = np.unique(length[length < Q]).tolist()
        self.sizes = np.unique(np.minimum(Q, length // self.width)[length >= Q]).tolist()

    @cached_property
    def bits(self) -> np.ndarray:
        """Whether any q-gram begins with some bits; made in the task, so that it is not sent."""
        bits = np.zeros(1 << TABLE_BITS, bool)
        bits[(self.gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return bits

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the places whose q-gram an item has: text, place in it, and the first and last of its entries."""
        at, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for size in self.sizes:
            g = q_grams(data, size)
            some = np.flatnonzero(self.bits[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            inside = some + size <= offsets[np.searchsorted(offsets, some, "right")]
            at, values = np.concatenate([at, some[inside]]), np.concatenate([values, g[some[inside]]])
        for n in self.lengths:
            few = [short_grams(data[a:b], n) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            at = np.concatenate([at, *(p + a for (p, _), a in zip(few, offsets[:-1], strict=True))])
            values = np.concatenate([values, *(v for _, v in few)])
        begin, end = np.searchsorted(self.gram, values, "left"), np.searchsorted(self.gram, values, "right")
        some = np.flatnonzero(end > begin)
        some = some[np.argsort(at[some], kind="stable")]
        doc = np.searchsorted(offsets, at[some], "right") - 1
        return doc, at[some] - offsets[doc], begin[some], end[some]

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and band (of the diagonals from band times width on, two widths wide) with enough q-grams of the item."""
        doc, place, begin, end = self.hits(data, offsets)
        shift, span = int(self.high.max()) + 3, int(len(data) + self.high.max()) + 8
        held, counts = [], []
        edges = np.append(np.searchsorted(np.cumsum(end - begin), np.arange(0, (end - begin).sum(), _VOTES // 4), "left"), len(doc))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = (end - begin)[a:b]
            entry = np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            d, p, w = np.repeat(doc[a:b], n), np.repeat(place[a:b], n), self.width[entry]
            first, last = (p - self.high[entry]) // w - 1, (p - self.low[entry]) // w
            key = ((d * len(self.names) + self.item[entry]) * span) + shift
            n = last - first + 1
            inner = np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), _VOTES), "left"), len(n))
            for x, y in zip(inner[:-1], inner[1:], strict=True):
                m = n[x:y]
                votes = np.repeat(key[x:y] + first[x:y] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                names, times = np.unique(votes, return_counts=True)
                held.append(names)
                counts.append(times)
        if not held:
            return (np.zeros(0, np.int64),) * 3
        names, at = np.unique(np.concatenate(held), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts))
        item = names // span % len(self.names)
        good = total >= self.needed[item]
        names, item = names[good], item[good]
        return names // span // len(self.names), item, names % span - shift


def _count_bands(block: _Block):
    """For each text the items with the bands that have enough of their q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            data, offsets, _ = normalise(*tx.utf8(part.column("text")))
            doc, item, band = block.bands(data, offsets)
            if not len(doc):
                continue
            pair = doc * len(block.names) + item
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            rows = part.select(["doc_id", "key"]).take(pa.array(doc[first]))
            lists = tx.list_column(band, np.diff(np.append(first, len(pair))), pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(block.names[item[first]]), lists], ["doc_id", "key", "no", "bands"])

    return run


def banded_distances(items: list[bytes], texts: list[bytes], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item and text: the least edit distance of the item to any part of the text, and where that part begins and ends.

    The band: character i of an item meets characters i to i + width of its text only.  All pairs advance together.
    """
    far, scale = np.int64(1) << 44, np.int64(1) << 24
    size, limit = np.array([len(a) for a in items]), np.array([len(b) for b in texts])[:, None]
    a = np.zeros((len(items), size.max()), np.int16)
    b = np.full((len(items), max(limit.max(), size.max() + widths.max() + 1)), -1, np.int16)
    for r, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[r, : len(x)], b[r, : len(y)] = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    steps = np.arange(widths.max() + 1)
    slope, outside = steps * scale, steps > widths[:, None]
    # the value of column j after i characters: cost * scale + begin, at text place i + j; any begin is free
    row = np.where(outside | (steps > limit), far, steps)
    result = np.zeros((3, len(items)), np.int64)
    for i in range(1, a.shape[1] + 1):
        best = row + np.where(b[:, i - 1 : i + len(steps) - 1] == a[:, i - 1 : i], 0, scale)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + scale)  # a character of the item left out
        shut = outside | (steps + i > limit)
        best[shut] = far
        row = np.minimum.accumulate(best - slope, axis=1) + slope  # characters of the text left out
        row[shut] = far
        for r in np.flatnonzero(size == i):
            j = int(row[r].argmin())
            result[:, r] = row[r, j] // scale, row[r, j] % scale, i + j
    return result[0], result[1], result[2]


class _Search:
    """The places of one item in one text: bands are aligned from left to right until none is left."""

    def __init__(self, row: int, item: dict, data: np.ndarray) -> None:
        self.row, self.item, self.data, self.size = row, item, data, len(item["body"])
        self.width = 2 * (item["budget"] + 1)
        self.left = np.unique(np.array(item["bands"], np.int64)) * (item["budget"] + 1)
        self.found: list[tuple[int, int, int]] = []

    def next(self) -> list[int]:
        """The first bands that are left in every stretch of four times the item's length, with those that overlap them."""
        stretch = self.left // (4 * self.size)
        first = self.left[np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))] if len(self.left) else self.left
        return self.left[self.left <= first[np.searchsorted(first, self.left, "right") - 1] + self.width].tolist() if len(first) else []

    def window(self, low: int) -> bytes:
        """The text of a band; where it begins before the text, bytes that match nothing keep its origin."""
        return bytes(max(-low, 0)) + self.data[max(low, 0) : low + self.size + self.width].tobytes()

    def settle(self, tried: list[int], results: list[tuple[int, int, int]]) -> None:
        """Keep the best of each group of overlapping bands; what lies inside a place found is done."""
        self.left = np.setdiff1d(self.left, tried)
        best: dict[int, tuple[int, int, int]] = {}
        group = 0
        for i, (low, (cost, begin, end)) in enumerate(zip(tried, results, strict=True)):
            if i and low > tried[group] + self.width:
                group = i
            if cost <= self.item["budget"]:
                best[group] = min(best.get(group, (1 << 30, 0, 0)), (cost, max(0, low + begin), low + end))
        if best:
            self.data = self.data.copy()
        for cost, begin, end in best.values():
            self.found.append((begin, end, cost))
            self.data[begin:end] = 0  # what is found matches no second time
            self.left = self.left[(self.left + self.width <= begin) | (self.left + self.width > end)]

    def places(self) -> Iterator[tuple[int, int, int]]:
        """The places found; of two that overlap the one with fewer edits, then the first."""
        done = 0
        kept: list[tuple[int, int, int]] = []
        for begin, end, cost in sorted(self.found):
            if kept and begin < done:
                if cost >= kept[-1][2]:
                    continue
                kept.pop()
            kept.append((begin, end, cost))
            done = end
        yield from kept


def _align(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for part in tx.slices(batches, "text", max_rows=512):
        raw, at = tx.utf8(part.column("text"))
        data, offsets, origin = normalise(raw, at)
        searches = [_Search(d, item, data[offsets[d] : offsets[d + 1]]) for d, items in enumerate(part.column("items").to_pylist()) for item in items]
        active = searches
        while active:
            tried = [(s, s.next()) for s in active]
            jobs = sorted(((s, low) for s, lows in tried for low in lows), key=lambda j: j[0].size)
            results: dict[tuple[int, int], tuple[int, int, int]] = {}
            for i in range(0, len(jobs), 256):
                some = jobs[i : i + 256]
                answers = banded_distances([s.item["body"] for s, _ in some], [s.window(low) for s, low in some], np.array([s.width for s, _ in some]))
                results.update({(id(s), low): tuple(answer) for (s, low), answer in zip(some, np.stack(answers, 1).tolist(), strict=True)})
            for s, lows in tried:
                s.settle(lows, [results[id(s), low] for low in lows])
            active = [s for s in active if len(s.left)]
        out = []
        lead = np.cumsum((raw & 0xC0) != 0x80)
        for s in searches:
            base, first = (lead[at[s.row] - 1] if at[s.row] else 0), offsets[s.row]
            for begin, end, cost in s.places():
                a, b = origin[first + begin], origin[min(first + end, offsets[s.row + 1]) - 1]
                out.append((s.row, s.item["item_id"], int(lead[a] - 1 - base), int(lead[b] - base), cost))
        if out:
            rows, items, starts, ends, edits = zip(*out, strict=True)
            own = part.select(["doc_id", "key"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(items, id_type), *(pa.array(v, pa.int32()) for v in (starts, ends, edits))], ["doc_id", "key", "item_id", "start", "end", "edits"])


def _candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, key, no, bands``: for each text and item the bands with enough q-grams of it."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    order = W.orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = items.select("no", F.size("grams").alias("n"))  # a row for each item: a benchmark, not a corpus
    numbered = sizes.withColumn("block", F.floor((F.sum("n").over(order) - F.col("n")) / BLOCK_GRAMS)).checkpoint()
    found = None
    for number in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        own = items.join(F.broadcast(numbered.where(F.col("block") == number).select("no")), "no", "left_semi")
        table = own.select("no", "needed", "width", F.length("body").alias("length"), F.explode("grams").alias("g")).select("no", "needed", "width", "length", "g.*").toArrow()  # one block
        if len(table):
            bands = texts.mapInArrow(_count_bands(_Block(table)), f"doc_id {kind}, key long, no long, bands array<long>").checkpoint()
            found = bands if found is None else found.unionByName(bands)
    return found


def _leaks(docs: DataFrame, benchmark: DataFrame, error: float) -> DataFrame:
    """The rows of find_leaks() with ``key``, a hash of the text."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    spark = docs.sparkSession
    shared_folder(spark)
    texts = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    named = benchmark.select("item_id", "text").where("text is not null").distinct().withColumn("no", F.xxhash64("item_id", "text")).checkpoint()
    items = named.select("no", "text").mapInArrow(_prepare(error), _ITEM).checkpoint()
    out = f"doc_id {kinds[0]}, key long, item_id {kinds[1]}, start int, end int, edits int"
    regions = _candidates(texts, items)
    if regions is None:
        return spark.createDataFrame([], out)
    regions = regions.groupBy("doc_id", "key", "no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bands")))).alias("bands")).checkpoint()  # equal rows have equal bands
    wanted = regions.join(items.select("no", "body", "budget"), "no").join(named.select("no", "item_id"), "no")
    wanted = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("item_id", "body", "budget", "bands")).alias("items"))
    hit = few_or_shuffled(regions.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))
    rows = texts.join(hit, same, "left_semi").join(wanted, same).select("doc_id", "key", "text", "items")
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    return rows.mapInArrow(lambda b: _align(b, id_type), out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, error: float = 0.1) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: the places of each item in each document that holds it.

    ``error`` is the share of an item's characters that may be edited, insertions and deletions included.  Offsets count
    code points of the text, end exclusive.  Places of an item do not overlap: of overlapping ones the one with fewer edits
    counts, then the first.  Shorter items with many edits are looked for by shorter q-grams, so that the budget is the stated share for
    every length.  Items with fewer than 8 letters, digits and blanks between words match where their words stand
    unchanged, as words of their own; null items and those without letters and digits match nothing, nor do null or empty
    texts.  Every input row is searched, so repeated documents give repeated rows; of equal items one is searched, items
    that share an identifier or a text each give their rows.  Texts of any length are one row's work.
    """
    return _leaks(docs, benchmark, error).drop("key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, error: float = 0.1) -> DataFrame:
    """The documents that hold no item; rows are judged by identifier and text."""
    leaks = few_or_shuffled(_leaks(docs, benchmark, error).select(F.col("doc_id").alias("_leak"), F.col("key").alias("_text")).distinct())
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")) & (F.xxhash64("text") == F.col("_text")), "left_anti")


def leaks_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and item it holds, with the places and the number of edits."""
    return find_leaks(docs, benchmark)
