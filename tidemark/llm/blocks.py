"""Candidate pairs of long index lists, met in blocks of bounded size.

The rows of a list that are in its largest component need not meet each other, nor those of one hub; the others meet rows of a
size that may link.  They are dealt into blocks by size and by a hash, and each pair of blocks is one group of rows, so that no task gets more
than two blocks at once however long a list is, and sizes apart are skipped before the shuffle.  Inside a pair of blocks, sizes, positions,
components, hubs and sketches are tested before a pair is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 1024


def sketch(s: np.ndarray) -> bytes:
    """A bit for each value of the low bits of a set's hashes; a power of two of them, two to four for each hash."""
    bits = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_shared(n: int, a: bytes, m: int, b: bytes) -> int:
    """An upper bound of the intersection of sets of sizes n and m with sketches a and b: bits that one lacks are not shared."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, width), 0) for z in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """The smallest intersection of linked sets of sizes n and m: t / (100 + t) of their sum, rounded up."""
    return -(-threshold * (n + m) // (100 + threshold))


def possible(meta_a: np.ndarray, meta_b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes and positions in an index list leave room for a link."""
    n, m, i, j = meta_a >> 32, meta_b >> 32, meta_a & 0xFFFFFFFF, meta_b & 0xFFFFFFFF
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= least_overlap(n, m, threshold))


def runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first ones, regrouped so that no value of these keys is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if held and last == 0 and all(h[-1] == c[0] for h, c in zip(held[-1][:keys], columns[:keys], strict=True)):
            held.append(columns)
            continue
        held.append([c[:last] for c in columns])
        yield [np.concatenate(c) for c in zip(*held, strict=True)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _shared_bounds(n: int, a: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """most_shared of one set with many whose sketches have one width."""
    width = min(len(a), sketches.shape[1])
    x = np.bitwise_or.reduce(a.reshape(-1, width), 0).view(np.uint64)
    y = np.bitwise_or.reduce(sketches.reshape(len(sketches), -1, width), 1).view(np.uint64)
    return np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), sizes - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "sort", "level", "block", "with_level", "with_block", "side", "cls", "meta", "component", "hub", "major", "bits"]
        for columns in runs(batches, names, 6):
            keys = np.stack([c.astype(np.int64) for c in columns[:6]])
            edges = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))), keys.shape[1])
            side, cls, meta, component, hub, major, bits = columns[6:]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                middle = lo + int(np.searchsorted(side[lo:hi], 1))
                if not lo < middle < hi:
                    continue
                x, y = slice(lo, middle), slice(middle, hi)
                room = (component[x][:, None] != component[y][None, :]) & (hub[x][:, None] != hub[y][None, :]) & possible(meta[x][:, None], meta[y][None, :], threshold)
                room &= major[y][None, :] | (cls[x][:, None] < cls[y][None, :])  # two that are both on the first side meet twice
                n, m = meta[x] >> 32, meta[y] >> 32
                raw = [np.frombuffer(b, np.uint8) for b in bits[lo:hi]]
                widths = np.array([len(r) for r in raw[middle - lo :]])
                for width in np.unique(widths).tolist():
                    of = np.flatnonzero(widths == width)
                    matrix = np.stack([raw[middle - lo + i] for i in of])
                    for i in np.flatnonzero(room[:, of].any(1)).tolist():
                        js = np.flatnonzero(room[i, of])
                        ok = of[js[_shared_bounds(int(n[i]), raw[i], m[of[js]], matrix[js]) >= least_overlap(n[i], m[of[js]], threshold)]]
                        if len(ok):
                            a, b = np.full(len(ok), cls[x][i]), cls[y][ok]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def pairs_across(rows: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` (a < b, with repeats): pairs of rows ``token, cls, meta, component, hub`` of one token that are in different components
    and of different hubs, and whose sizes, positions (both in meta) and sketches (``cls, n, bits``) leave room for a link.

    Of a list's largest component and its commonest hub, rows that have both ("both") only need to meet rows that have neither
    ("none"); those that have one of the two also meet those that have the other.  So a list of near copies, nearly all of
    which have both, moves only where it has a foreign row.  Small tables are merged, not broadcast: that passes through the driver.
    """
    most = lambda c: rows.groupBy("token", c).agg(F.count("*").alias("_rows")).groupBy("token").agg(F.max(F.struct("_rows", c))[c].alias(f"_{c}"), F.count("*").alias(f"_n_{c}")).where(f"_n_{c} > 1")
    mixed = most("component").join(most("hub").hint("merge"), "token").select("token", "_component", "_hub").checkpoint()
    # sizes of linked sets are at most one level apart
    level = F.floor(F.log(F.shiftright("meta", 32).cast("double")) / (math.log(100 / threshold) * 1.000001)).cast("int")
    inside, same = F.col("component") == F.col("_component"), F.col("hub") == F.col("_hub")
    kind = F.when(inside & same, "both").when(inside, "inside").when(same, "hub").otherwise("none")
    tagged = rows.join(mixed.hint("merge"), "token").select("token", "cls", "meta", "component", "hub", kind.alias("kind"), level.alias("level")).checkpoint()
    blocks = lambda when, name: F.ceil(F.count_if(when) / BLOCK_ROWS).cast("int").alias(name)
    counts = tagged.groupBy("token", "level").agg(blocks(F.lit(True), "n_all"), *(blocks(F.col("kind") == k, f"n_{k}") for k in ("none", "hub", "inside")))
    beside = counts.select("token", F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1)).alias("level"), F.struct(F.col("level").alias("with"), "n_all", "n_none", "n_hub", "n_inside").alias("o"))
    # three at most; a plain table, so that joins can split a hot list
    beside = beside.groupBy("token", "level").agg(F.collect_list("o").alias("beside")).join(counts, ["token", "level"]).checkpoint()
    own = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(F.col(f"n_{n}"), F.lit(1))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def sent(side: int, sort: int, mine: str, theirs: str):
        """The groups of a row that is on a side of them: its own block of some kind of rows with all blocks of another kind."""

        def of(o):
            first, second = (F.col("level"), o["with"]) if side == 0 else (o["with"], F.col("level"))
            place = lambda i: F.struct(F.lit(sort).alias("sort"), first.alias("level"), (own(mine) if side == 0 else i).alias("block"), second.alias("with_level"), (i if side == 0 else own(mine)).alias("with_block"), F.lit(side).alias("side"))
            return F.transform(upto(o[f"n_{theirs}"]), place)

        return F.flatten(F.transform("beside", of))

    foreign = sent(1, 0, "all", "none")  # every row is met by those that have neither
    to = F.when(F.col("kind") == "none", F.concat(foreign, sent(0, 0, "none", "all"))).when(F.col("kind") == "hub", F.concat(foreign, sent(0, 1, "hub", "inside")))
    to = to.when(F.col("kind") == "inside", F.concat(foreign, sent(1, 1, "inside", "hub"))).otherwise(foreign)
    dealt = tagged.join(beside.hint("merge"), ["token", "level"]).withColumn("to", to).where(F.size("to") > 0).select("token", "cls", "meta", "component", "hub", (F.col("kind") != "none").alias("major"), "to")
    dealt = dealt.join(sketches.select("cls", "bits"), "cls").withColumn("to", F.explode("to"))
    key = ["token", "sort", "level", "block", "with_level", "with_block"]
    met = dealt.select("token", *(F.col("to")[c].alias(c) for c in (*key[1:], "side")), "cls", "meta", "component", "hub", "major", "bits")
    return met.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(_compare(threshold), "a long, b long")
