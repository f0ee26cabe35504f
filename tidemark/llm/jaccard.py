"""Exact n-gram Jaccard join, reported as components of similar documents.

A document is the set of its distinct word shingles; documents with equal sets form a class and are handled once.  Classes
link when ``100 * intersection >= threshold * union``.

Candidates come from prefix filtering.  All shingles have one global order, rare ones first (by a count sketch of fixed
size, then by hash; any order is correct, this one keeps index lists short).  Two linked sets share a shingle among the
first ones of both, at positions that leave enough shingles behind it.  Index lists are the rows of one prefix shingle,
met by a shuffle; pairs whose sizes rule out a link are skipped there, and so are those that meet in too few lists.

Set relations skip the rest.  A short list gives all its pairs; a long list first gives the pairs with its hub only, the
class in which the shingle stands foremost.  Each class is verified against its most promising partner, which yields its
difference to that hub; links among the sets of one hub follow from those differences, without their sets.  What is left are
pairs of different components and different hubs: of short lists, and of long lists, which are dealt over tasks in blocks, with
sizes apart skipped before the shuffle and positions and sketches tested before a pair is made (blocks.py).  Of these only
the pairs whose sketches (two to four bits a shingle) leave room for a link have their sets compared.  Pairs inside a
component have their answer from those of the sets they resemble and are never expanded, so a group of thousands of near
copies costs about as many verifications as it has members.

Sets are rebuilt from the texts where they are verified; only prefixes, pairs and the sets of candidate pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as tx
from .blocks import least_overlap, most_shared, pairs_across, possible, runs, sketch
from .components import components
from .session import few_or_shuffled, shared_folder

SHINGLE_WORDS = 5
SKETCH_BITS = 20
SHORT_LIST = 16
#: Classes, and partners of all of them, that are broadcast to pick texts; beyond it the texts are joined by a shuffle.
BROADCAST_CLASSES, BROADCAST_PARTNERS = 200_000, 1_000_000
#: The index list of a shingle that more rows may have is dealt over several tasks.
LIST_ROWS = 50_000
PIVOT_ROWS = 2000
_SLICE = 4096
_KEEP_BITS = np.uint64(58)


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, offsets = tx.utf8(texts)
    data = tx.LOWER[data]
    starts, ends, doc = tx.words(data, offsets, tx.NON_BLANK)
    h = tx.run_hashes(data, starts, ends, tx.NON_BLANK)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = tx.windows(h, words)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(grams[a : b - words + 1]))
        else:
            sets.append(tx.windows(h[a:b], b - a) if b > a else grams[:0])
    return sets


def digests(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent 64-bit digests of a set and its size; of the first one only so many bits are kept."""
    first, second = ((tx.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64) for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B))
    return int(first) if bits == 64 else int(first) & ((1 << bits) - 1), int(second)


@dataclass(frozen=True)
class Names:
    """Names of classes: the first digest of a set, or the second one where different sets share the first."""

    bits: int = 64
    clashes: frozenset[int] = frozenset()

    def of(self, s: np.ndarray) -> tuple[int, int]:
        """The name of a set, and its other digest, by which a clash is seen."""
        first, second = digests(s, self.bits)
        return (second, first) if first in self.clashes else (first, second)


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for part in tx.slices(batches, "text"):
        sets = shingle_sets(part.column("text"))
        if sets:
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
    places = counts.reshape(-1, _SLICE)
    full = np.flatnonzero(places.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([places[i].tobytes() for i in full], pa.binary())], ["place", "counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int32).astype(np.int64) for c in table["counts"])
    return pa.table({"place": pa.array([table["place"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def rarity_levels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each sketch bucket a level, 0 for usual ones, growing with the logarithm of the count above the mean, and the number
    of parts that the index lists in it are dealt over."""
    sketches = docs.select("text").mapInArrow(_count, "place int, counts binary")
    total = np.zeros(1 << SKETCH_BITS)
    for place, counts in sketches.groupBy("place").applyInArrow(_sum_counts, "place int, counts binary").collect():  # 2**SKETCH_BITS numbers
        total[place * _SLICE : (place + 1) * _SLICE] = np.frombuffer(counts, np.int64)
    mean = max(1.0, total.mean())
    return np.clip(np.floor(4 * np.log2(np.maximum(total, 1) / mean)), 0, 63).astype(np.uint8), np.where(total > LIST_ROWS, np.ceil(total / LIST_ROWS), 0).astype(np.int32)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order, as values that sort in it."""
    return np.sort(levels[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << _KEEP_BITS | s >> np.uint64(6))


def _postings(docs: DataFrame, levels: np.ndarray, parts: np.ndarray, names: Names, threshold: int) -> DataFrame:
    """``token, part, cls, meta``: a row for each prefix shingle of a class; part is 0 but for shingles of long lists (from 1)."""
    dealt = parts if parts.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has emitted
        for part in tx.slices(batches, "text"):
            tokens, classes, sizes = [], [], []
            for s in shingle_sets(part.column("text")):
                c, _ = names.of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                tokens.append(_ordered(s, levels)[: prefix_length(len(s), threshold)])
                classes.append(c)
                sizes.append(len(s))
            if classes:
                lengths, token = np.array([len(t) for t in tokens]), np.concatenate(tokens)
                own = np.zeros(len(token), np.int32)
                if dealt is not None:
                    bucket = (token >> np.uint64(_KEEP_BITS - np.uint64(SKETCH_BITS))) & np.uint64((1 << SKETCH_BITS) - 1)
                    n = dealt[bucket.astype(np.int64)]
                    own = np.where(n > 0, 1 + np.repeat(np.array(classes), lengths) % np.maximum(n, 1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), tx.list_column(token.view(np.int64), lengths, pa.int64()), tx.list_column(own, lengths, pa.int32())], ["cls", "n", "tokens", "parts"])

    lists = docs.select("text").mapInArrow(run, "cls long, n long, tokens array<long>, parts array<int>")
    rows = lists.select("cls", "n", F.posexplode(F.arrays_zip("tokens", "parts")).alias("at", "x"))
    return rows.select(F.col("x.tokens").alias("token"), F.col("x.parts").alias("part"), "cls", (F.shiftleft("n", 32) + F.col("at")).alias("meta"))


_CANDIDATE = "kind int, token long, a long, b long, meta long"


def _candidate_rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns["a"])
    zero = np.zeros(size, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *(pa.array(columns.get(c, zero).astype(np.int64)) for c in ("token", "a", "b", "meta"))], ["kind", "token", "a", "b", "meta"])


def _pairs_of_lists(threshold: int):
    """Kind 0: a candidate pair, token both sizes, meta the number of lists it was met in.  Kind 1: a row of a long list, or of
    one that is dealt over parts.  Kind 2: the hub of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, part, cls, meta in runs(batches, ["token", "part", "cls", "meta"]):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, part, cls, meta = token[new], part[new], cls[new], meta[new]
            edge = np.ones(len(token), bool)
            edge[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(token)))
            begin, length = np.repeat(start, size), np.repeat(size, size)
            one, two = [], []
            short = np.flatnonzero((length > 1) & (length <= SHORT_LIST) & (part == 0))
            for d in range(1, SHORT_LIST):
                left = short[short + d < begin[short] + length[short]]
                if not len(left):
                    break
                n, m = meta[left] >> 32, meta[left + d] >> 32
                ok = left[100 * np.minimum(n, m) >= threshold * np.maximum(n, m)]
                one.append(ok)
                two.append(ok + d)
            # the hub of a long list: where the token stands foremost, as in a text that others were edited from
            order = np.lexsort((cls, meta & 0xFFFFFFFF, begin))
            hub = np.repeat(order[start], size)
            large = (length > SHORT_LIST) | (part > 0)
            long = np.flatnonzero(large & (hub != np.arange(len(token))))
            ok = long[possible(meta[hub[long]], meta[long], threshold)]
            one, two = np.concatenate([*one, hub[ok]]), np.concatenate([*two, ok])
            if len(one):
                turned = cls[one] > cls[two]
                one, two = np.where(turned, two, one), np.where(turned, one, two)
                order = np.lexsort((cls[two], cls[one]))
                one, two = one[order], two[order]
                first = np.flatnonzero(np.append(True, (cls[one][1:] != cls[one][:-1]) | (cls[two][1:] != cls[two][:-1])))
                times, one, two = np.diff(np.append(first, len(one))), one[first], two[first]
                yield _candidate_rows(0, token=(meta[one] >> 32 << 32) | meta[two] >> 32, a=cls[one], b=cls[two], meta=times)
            if large.any():
                yield _candidate_rows(1, token=token[large], a=cls[large], meta=meta[large])
            heads = np.unique(hub[part > 0])
            if len(heads):
                yield _candidate_rows(2, token=token[heads], a=cls[heads], meta=meta[heads])

    return run


def _across_parts(candidates: DataFrame) -> DataFrame:
    """The candidates with pairs of each part's hub and that of the whole list, where a list was dealt over parts."""
    hubs = candidates.where("kind = 2").select("token", "a", "meta")
    place = F.col("meta").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = hubs.groupBy("token").agg(F.min(F.struct(place.alias("at"), F.col("a").alias("cls"), F.col("meta").alias("meta"))).alias("w"))
    both = hubs.join(whole, "token").where(F.col("a") != F.col("w.cls")).select("a", "meta", F.col("w.cls").alias("b"), F.col("w.meta").alias("other"))
    swap = F.col("a") > F.col("b")
    n, m = F.shiftright("meta", 32), F.shiftright("other", 32)
    sizes = F.shiftleft(F.when(swap, m).otherwise(n), 32).bitwiseOR(F.when(swap, n).otherwise(m))
    pairs = both.select(F.lit(0).alias("kind"), sizes.alias("token"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("meta"))
    return candidates.where("kind < 2").unionByName(pairs)


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, names: Names, threshold: int, words: int) -> DataFrame:
    """``a, b, linked, n, base, lost, gained`` of pairs ``a, b``.

    The sets of all partners of a class meet its own, which each part of them gets.  Similar sets (half of the union shared)
    come with their difference: the places of a's set that b lacks, and what b has besides; n and base are their sizes.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
    sent = pairs.join(parts, "a").select(F.col("b").alias("cls"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side")).alias("to"))
    own = parts.select(F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("cls", F.struct(F.col("cls").alias("a"), "part", F.lit(0).alias("side")).alias("to"))
    wanted = sent.unionByName(own).groupBy("cls").agg(F.collect_list("to").alias("to")).join(classes.select("cls", F.col("doc").alias("_doc")), "cls").checkpoint()
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("to")), F.lit(0)).alias("partners")).first()
    side = F.broadcast(wanted) if size["n"] <= BROADCAST_CLASSES and size["partners"] <= BROADCAST_PARTNERS else wanted.hint("shuffle_hash")
    rows = texts.join(side, F.col("_id").eqNullSafe(F.col("_doc"))).select("text", "cls", "to")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", max_bytes=1 << 19):
            out = []
            for s, c, to in zip(shingle_sets(part.column("text"), words), part.column("cls").to_pylist(), part.column("to").to_pylist(), strict=True):
                if names.of(s)[0] == c:  # not another text under the same identifier
                    raw = s.tobytes()
                    out += [(t["a"], t["part"], t["side"], c, raw) for t in to]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "part", "side", "cls", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for a, side, c, tokens in zip(*(batch.column(n).to_pylist() for n in ("a", "side", "cls", "tokens")), strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if side == 0:
                    name, pivot = a, s
                elif name == a:
                    at = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                    shared = pivot[at] == s
                    both = int(shared.sum())
                    union = len(pivot) + len(s) - both
                    lost = gained = None
                    if 2 * both >= union:
                        kept = np.zeros(len(pivot), bool)
                        kept[at[shared]] = True
                        lost, gained = np.flatnonzero(~kept).astype(np.int32).tobytes(), s[~shared].tobytes()
                    for column, value in zip(out, (a, c, 100 * both >= threshold * union, len(s), len(pivot), lost, gained), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["a", "b", "linked", "n", "base", "lost", "gained"])

    met = rows.mapInArrow(sets, "a long, part int, side int, cls long, tokens binary").repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return met.mapInArrow(check, "a long, b long, linked boolean, n long, base long, lost binary, gained binary")


def _links(verified: DataFrame) -> DataFrame:
    return verified.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _often_enough(candidates: DataFrame, threshold: int) -> DataFrame:
    """``a, b, met``: the pairs that meet in enough lists to be able to link.

    Linked sets of sizes n and m share at least least_overlap(n, m) shingles, hence so many of the first ones of both that
    they meet in at least 1 + that - threshold * max(n, m) / 100 lists.  Short lists have counted all their pairs; in long
    ones a pair may have met as often as the rarer of its classes stands in any.
    """
    long = candidates.where("kind = 1").groupBy("a").agg(F.count("*").alias("n"))
    pairs = candidates.where("kind = 0").groupBy("a", "b").agg(F.sum("meta").alias("met"), F.max("token").alias("sizes"))
    pairs = pairs.withColumn("n", F.shiftright("sizes", 32)).withColumn("m", F.col("sizes").bitwiseAND(F.lit(0xFFFFFFFF)))
    up = lambda x, by: F.floor((x + by - 1) / by)
    least = 1 + up(threshold * (F.col("n") + F.col("m")), 100 + threshold) - up(threshold * F.greatest("n", "m"), 100)
    pairs = pairs.withColumn("short_of", least - F.col("met"))
    for c in ("a", "b"):
        pairs = pairs.join(long.select(F.col("a").alias(c), F.col("n").alias(f"_{c}")), c, "left")
    return pairs.where(F.col("short_of") <= F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))).select("a", "b", "met")


def _best_partners(pairs: DataFrame) -> DataFrame:
    """``a, b``: for each class b the partner a that most index lists name as a hub, among those it met often."""
    both = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), "met").unionByName(pairs.select("b", "a", "met"))
    weight = both.groupBy("a").agg(F.sum("met").alias("weight")).checkpoint()  # plain tables, so that joins can split a hub's rows
    most = both.groupBy("b").agg(F.max("met").alias("most")).checkpoint()
    order = F.struct((2 * F.col("met") < F.col("most")).alias("seldom"), (-F.col("weight")).alias("weight"), (-F.col("met")).alias("met"), "a")
    best = both.join(weight, "a").join(most, "b").groupBy("b").agg(F.min(order)["a"].alias("a")).select("a", "b")
    return best.withColumn("_low", F.least("a", "b")).withColumn("_high", F.greatest("a", "b")).dropDuplicates(["_low", "_high"]).select("a", "b")


def _around_hubs(verified: DataFrame, labels: DataFrame, threshold: int, rows: int = 4000) -> DataFrame:
    """Links between sets that were compared with the same hub, from their differences to it: ``u, v``.

    Of a hub's sets those outside its component meet all others.  The intersection of two sets is what the hub has and
    neither lacks, and what both have besides.  Links inside what is connected already are not looked for, so there
    are fewer links than sets.  The others of a large hub are dealt over parts that each get those outside.
    """
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
    sets = verified.where("lost is not null").select("a", "b", "n", "base", "lost", "gained")
    sets = sets.join(of("b", "_cb"), "b", "left").join(of("a", "_ca"), "a", "left").withColumn("component", F.coalesce("_cb", "b")).withColumn("outside", F.col("component") != F.coalesce("_ca", "a"))
    counts = sets.groupBy("a").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"), F.max("outside").alias("some")).where("some").select("a", "parts")
    dealt = sets.join(counts, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    parts = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    dealt = dealt.withColumn("part", F.explode(parts)).select("a", "part", "b", "n", "base", "component", "outside", "lost", "gained")

    def decide(group: list[tuple]) -> Iterator[tuple[int, int]]:
        base = group[0][2]
        names, sizes = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        lost = [np.frombuffer(g[5], np.int32) for g in group]
        gained = [np.frombuffer(g[6], np.uint64) for g in group]
        root = {c: c for c in {g[3] for g in group}}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
            m = np.zeros((len(lists), width), np.float32)
            m[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else []] = 1
            return m

        outside = [i for i, g in enumerate(group) if g[4]]
        for i in range(0, len(outside), 128):
            x = outside[i : i + 128]
            lost_x = matrix([lost[k] for k in x], base)
            words = np.unique(np.concatenate([gained[k] for k in x]))
            gain_x = matrix([np.searchsorted(words, gained[k]) for k in x], len(words))
            for j in range(0, len(group), 1024):
                y = range(j, min(j + 1024, len(group)))
                missing = np.array([len(lost[k]) for k in x])[:, None] + np.array([len(lost[k]) for k in y])[None, :] - lost_x @ matrix([lost[k] for k in y], base).T
                places = [np.searchsorted(words, gained[k]) for k in y]
                known = [p[(p < len(words)) & (words[np.minimum(p, len(words) - 1)] == gained[k])] if len(words) else p[:0] for p, k in zip(places, y, strict=True)]
                both = base - missing + gain_x @ matrix(known, len(words)).T
                linked = 100 * both >= threshold * (sizes[x][:, None] + sizes[j : j + len(y)][None, :] - both)
                for p, q in zip(*np.nonzero(linked), strict=True):
                    u, v = top(group[x[p]][3]), top(group[j + q][3])
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        yield int(names[x[p]]), int(names[j + q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            found = []
            for a, part, *row in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "n", "base", "component", "outside", "lost", "gained")), strict=True):
                if (a, part) != at:
                    found += decide(group) if group else []
                    at, group = (a, part), []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])
        found = list(decide(group)) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return dealt.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "u long, v long")


def _undecided(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that are neither in one component nor compared with the same hub (``node, component, hub`` of known)."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"), F.col("hub").alias(f"_h{c}")).hint("merge")
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where((F.coalesce("_a", "a") != F.coalesce("_b", "b")) & (F.coalesce("_ha", "a") != F.coalesce("_hb", "b"))).select("a", "b")


def _plausible(sketches: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches leave room for a link; the others share too little, and their sets stay where they are."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    known = sketches.join(wanted, "cls", "left_semi").select("cls", F.struct("n", "bits").alias("s"))
    both = pairs.join(known.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(c).to_pylist() for c in ("n", "x", "m", "y"))
            least = least_overlap(np.array(n, np.int64), np.array(m, np.int64), threshold)
            room = [most_shared(*four) >= at_least for *four, at_least in zip(n, x, m, y, least.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(room, pa.bool_()))

    return both.select("a", "b", F.col("sa.n").alias("n"), F.col("sa.bits").alias("x"), F.col("sb.n").alias("m"), F.col("sb.bits").alias("y")).mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, threshold: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of columns ``doc_id, text``, a row for each input row.

    ``component_id`` is the smallest identifier reachable by links, null where no row of a component has one.  Null texts and
    texts without words have no shingles and link with nothing; texts shorter than a shingle are one shingle as a whole.
    Repeated rows are copies of each other, and so are rows with equal identifiers only if their texts are alike.  Texts of
    any length are one row's work.  Columns besides the two are not looked at.  ``threshold`` is in percent.
    """
    return _components(docs, threshold).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, threshold: int = 75) -> DataFrame:
    """The documents (all columns) with one row left of each component: the smallest identifier, then the smallest text hash.

    Rows without words stay.  Of rows with one identifier those with other texts are documents of their own; of equal rows
    one stays; a null identifier comes after all others.
    """
    rows = _components(docs, threshold).where("n_shingles > 0").select("doc_id", "key", "component").checkpoint()
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    first = first.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    judged = rows.join(first, "component").groupBy("doc_id", "key").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    # most documents stay and have one row: only the others are looked up
    others = few_or_shuffled(judged.where("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("stays").alias("_stays")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    plain = docs.join(others, same, "left_anti")
    repeated = docs.join(others.where("_stays"), same, "left_semi").withColumn("_key", F.xxhash64("text"))
    place = F.row_number().over(W.partitionBy("doc_id", "_key").orderBy(*(F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text"))))
    return plain.unionByName(repeated.withColumn("_place", place).where("_place = 1").select(docs.columns))


def _members(docs: DataFrame, names: Names) -> DataFrame:
    """``doc_id, key, n_shingles, cls, other, sketch`` of every row; the sketch only once for each class and task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes whose sketch this task has emitted
        for part in tx.slices(batches, "text"):
            sets = shingle_sets(part.column("text"))
            named, sketches = [names.of(s) for s in sets], []
            for s, (c, _) in zip(sets, named, strict=True):
                sketches.append(sketch(s) if len(s) and c not in seen else None)
                seen.add(c)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([c for c, _ in named], pa.int64()), pa.array([o for _, o in named], pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "key", "n_shingles", "cls", "other", "sketch"])

    return docs.withColumn("key", F.xxhash64("text")).mapInArrow(members, f"doc_id {kind}, key long, n_shingles long, cls long, other long, sketch binary").checkpoint()


def _named(docs: DataFrame, bits: int, members=_members) -> tuple[DataFrame, Names]:
    """The members (rows with ``n_shingles, cls, other`` of documents and names), named so that different sets have different names.

    Two digests of 64 bits tell sets apart.  The first alone is a name unless it clashes, which is seen by the second; of n
    different sets about n * n / 2**65 do, so the list of clashes that every task gets is short, and mostly empty.
    """
    clash = lambda rows: rows.where("n_shingles > 0").groupBy("cls").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("cls")
    names = Names(bits)
    rows = members(docs, names)
    clashes = frozenset(r["cls"] for r in clash(rows).collect())
    if clashes:
        names = Names(bits, clashes)
        rows = members(docs, names)
        if not clash(rows).isEmpty():
            raise RuntimeError("different sets share both digests")
    return rows, names


def _components(docs: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """``doc_id, key, n_shingles, component, component_id``: a hash of the text, and a name of the component (null: no words)."""
    shared_folder(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows, names = _named(docs, bits)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc"))
    levels, parts = rarity_levels(docs)
    lists = _postings(docs, levels, parts, names, threshold).repartition("token", "part").sortWithinPartitions("token", "part", "cls")
    candidates = lists.mapInArrow(_pairs_of_lists(threshold), _CANDIDATE).checkpoint()
    candidates = _across_parts(candidates) if parts.any() else candidates
    pairs = _often_enough(candidates, threshold).checkpoint()

    labels = connect(docs, classes, pairs, candidates.where("kind = 1").select("token", F.col("a").alias("cls"), "meta"), known_sketches(rows), names, threshold, SHINGLE_WORDS)
    known = named_components(classes, labels)
    full = rows.where("n_shingles > 0").join(known, "cls").select("doc_id", "key", "n_shingles", "component", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def known_sketches(rows: DataFrame) -> DataFrame:
    """``cls, n, bits`` of rows of which some of each class hold its sketch."""
    return rows.where("sketch is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("bits"))


def connect(docs: DataFrame, classes: DataFrame, pairs: DataFrame, lists: DataFrame, sketches: DataFrame, names: Names, threshold: int, words: int) -> DataFrame:
    """``node, component`` of the classes that link with others.

    ``pairs`` (``a, b, met``) hold all candidates of short lists and those of long ones with their hubs; ``lists`` (``token, cls,
    meta``) are the rows of the long lists, where other pairs may link as well.  ``sketches`` are ``cls, n, bits``.
    """
    first = _best_partners(pairs).checkpoint()
    verified = _verify(docs, classes, first, names, threshold, words).checkpoint()
    as_links = lambda labels: labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = components(_links(verified))
    labels = components(as_links(labels).unionByName(_around_hubs(verified, labels, threshold)))  # from the stars: few rounds
    hubs = verified.where("lost is not null").select(F.col("b").alias("node"), F.col("a").alias("hub")).dropDuplicates(["node"])
    known = labels.join(hubs.hint("merge"), "node", "full").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("hub", "node").alias("hub")).checkpoint()

    long = lists.join(known.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
    more = pairs_across(long.withColumn("component", F.coalesce("component", "cls")).withColumn("hub", F.coalesce("hub", "cls")), sketches, threshold)
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _undecided(pairs.select("a", "b").unionByName(more).distinct(), known).join(done.hint("merge"), ["a", "b"], "left_anti").checkpoint()
    rest = _plausible(sketches, rest, threshold).checkpoint()
    found = _links(_verify(docs, classes, rest, names, threshold, words)).unionByName(as_links(labels))
    return components(found)


def named_components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``cls, component, component_id`` of all classes ``cls, doc``: the smallest identifier of each component."""
    tagged = classes.select("cls", "doc").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = tagged.groupBy("component").agg(F.min("doc").alias("component_id"))
    return tagged.join(heads, "component").select("cls", "component", "component_id")
