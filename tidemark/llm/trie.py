"""The prefix trie of conversations, built compressed: a Patricia tree over sorted conversations, expanded at the end.

A conversation is a path of turn digests.  Equal paths are one row with a count; rows are range-sorted by path, so that every
subtree is a run of rows.  One pass over each part of the sorted table keeps the open points of the current path on a
stack: the places where paths end, branch or are leaves, and at the edges of a part also the places that it shares with its
neighbour.  All aggregates are sums over a point's rows, hence parts can add theirs up: members; words of all members below a
point minus words of all nodes below it, which is what sharing saves; leaves; children.  Only points on the edges of
parts have more than one row to add.  Nodes with one child and no end of their own have the numbers of the point below, plus what
the edge between them saves, a suffix sum of the edge's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import shared_folder

DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Conversation identifiers that one row of the joined lists holds.
CHUNK = 4096
_POINT = "node binary, depth long, parent binary, n_convs long, conv_id long, all_words long, own_words long, n_leaves long, n_children long, ahead array<long>"


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` (structs ``digest``, hexadecimal, and ``words``) of rows ``conv_id, turn, role, text``, without the texts.

    Turns come in the order of ``turn``, null first; of equal turns the smaller role, then the smaller digest, is first.  A null
    role or text is the empty string; rows without ``conv_id`` are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    lists = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(paths: DataFrame, *, every: int = 20, most: int = 4) -> DataFrame:
    """Paths whose first turns are those of another conversation: of ``conv_id`` minus its remainder by ``every``, as many as
    the crc32 of the identifier leaves modulo ``most`` (fewer if it has fewer, none if it is not there)."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = paths.join(heads, base == F.col("_base"), "left").withColumn("_h", h)
    # the null head of an absent conversation makes an array of no turns
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


class _Open:
    """A point of the current path whose rows are being added up."""

    __slots__ = ("depth", "node", "new", "n", "conv", "total", "own", "leaves", "children")

    def __init__(self, depth: int, node: bytes, new: bool):
        self.depth, self.node, self.new = depth, node, new
        self.n = self.total = self.own = self.leaves = self.children = 0
        self.conv: int | None = None

    def add(self, n: int, conv: int, total: int, own: int, leaves: int) -> None:
        self.n, self.total, self.own, self.leaves = self.n + n, self.total + total, self.own + own, self.leaves + leaves
        self.conv = conv if self.conv is None else min(self.conv, conv)


def _shared(a: bytes, b: bytes) -> int:
    """The number of leading turns that two paths share."""
    m = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint64, m // 8) != np.frombuffer(b, np.uint64, m // 8))
    return (int(differ[0]) * 8 if len(differ) else m) // DIGEST


def _prefixes(path: bytes, upto: int) -> Iterator[bytes]:
    """The names of the nodes at depths 0 to upto of a path."""
    h = hashlib.md5(usedforsecurity=False)
    yield h.digest()
    for d in range(upto):
        h.update(path[d * DIGEST : (d + 1) * DIGEST])
        yield h.copy().digest()


def _name(path: bytes) -> bytes:
    return hashlib.md5(path, usedforsecurity=False).digest()


class _Path:
    """The open points along the row read last, from the root; ``upto[d]`` are its words in the first d turns."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.key, self.upto = b"", np.zeros(1, np.int64)
        self.out: list[tuple] = []

    def opened(self, depth: int, node: bytes) -> _Open:
        """A new point between others; its own words count once, those of the nodes below come with their rows."""
        v = _Open(depth, node, True)
        v.own = int(self.upto[depth] - self.upto[depth - 1]) if depth else 0
        return v

    def ensure(self, depth: int) -> None:
        """Make the node at a depth of the path a point."""
        at = len(self.stack)
        while at and self.stack[at - 1].depth > depth:
            at -= 1
        if not at or self.stack[at - 1].depth < depth:
            self.stack.insert(at, self.opened(depth, _name(self.key[: depth * DIGEST])))

    def close(self, depth: int) -> None:
        """Close all points deeper than a depth, each into the one above."""
        while self.stack and self.stack[-1].depth > depth:
            v = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            before = int(self.upto[v.depth - 1]) if v.depth else 0
            first = above.depth + 1 if above else 0
            ahead = (before - self.upto[first - 1 : v.depth]) if v.depth else np.zeros(1, np.int64)
            self.out.append((v.node, v.depth, above.node if above else None, v.n, v.conv, v.total - v.n * before, v.own, v.leaves, v.children, ahead.tolist()))
            if above:
                edge = before - int(self.upto[above.depth]) if v.new else 0
                above.add(v.n, v.conv, v.total, v.own + edge, v.leaves)
                above.children += v.new

    def row(self, key: bytes, upto: np.ndarray, n: int, conv: int, shared: int, leaf: bool) -> None:
        """Take the next path, which has so many turns in common with the one before (-1: there is none)."""
        depth, total = len(key) // DIGEST, int(upto[-1])
        if not self.stack:  # the first row of a part: what it shares with the part before is not new
            self.key, self.upto = key, upto
            self.stack = [_Open(d, node, False) for d, node in enumerate(_prefixes(key, shared))] if shared >= 0 else [_Open(0, _name(b""), True)]
        else:
            self.ensure(shared)
            self.close(shared)
            self.key, self.upto = key, upto
        if depth > self.stack[-1].depth:
            self.stack.append(_Open(depth, _name(key), True))
            self.stack[-1].add(n, conv, n * total, total - int(upto[depth - 1]), int(leaf))
        else:  # the empty path
            self.stack[-1].add(n, conv, 0, 0, int(leaf))

    def share_with_next(self, depth: int) -> None:
        """Make all nodes down to a depth points, as they go on in the next part."""
        have = {v.depth for v in self.stack}
        missing = [self.opened(d, node) for d, node in enumerate(_prefixes(self.key, depth)) if d not in have]
        self.stack = sorted([*self.stack, *missing], key=lambda v: v.depth)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray, int, int]]:
    for batch in batches:
        words = batch.column("words")
        ends, values = words.offsets.to_numpy(), words.values.to_numpy()
        for i, (part, key, n, conv) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n", "conv_id")), strict=True)):
            upto = np.zeros(ends[i + 1] - ends[i] + 1, np.int64)
            np.cumsum(values[ends[i] : ends[i + 1]], out=upto[1:])
            yield part, key, upto, n, conv


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    for batch in batches:
        if batch.num_rows:
            part, key = batch.column("part"), batch.column("path")
            first = first or (part[0].as_py(), key[0].as_py())
            last = key[-1].as_py()
    if first:
        yield pa.RecordBatch.from_pydict({"part": pa.array([first[0]], pa.int32()), "first": pa.array([first[1]], pa.binary()), "last": pa.array([last], pa.binary())})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, first = batch.column("before").to_pylist(), batch.column("first").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([_shared(a, b) for a, b in zip(before, first, strict=True)], pa.int64())], ["part", "shared"])


def _points(shared: dict[int, int]):
    """The points of each part; shared: turns in common with the part before, for all parts but the first."""
    after = dict(zip(sorted(shared)[:-1], sorted(shared)[1:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part, held = _Path(), None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*tree.out, strict=True)) or [()] * 10
            tree.out = []
            kinds = (pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _POINT.split(", ")])

        for row in _rows(batches):
            if held is not None:  # a path is a leaf unless the next one goes on from it
                common = _shared(held[1], row[1])
                tree.row(*held[1:], before, common < len(held[1]) // DIGEST)
                before = common
            else:
                part, before = row[0], shared[row[0]]
            held = row
            if len(tree.out) >= 4096:
                yield batch()
        if held is not None:
            common = shared[after[part]] if part in after else -1
            tree.row(*held[1:], before, common < len(held[1]) // DIGEST)
            if common >= 0:
                tree.share_with_next(common)
            tree.close(-1)
            yield batch()

    return run


def _compressed(sequences: DataFrame) -> DataFrame:
    """The points of the tree of rows ``path, words, n, conv_id`` with distinct paths."""
    rows = sequences.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).select("part", "path", "words", "n", "conv_id").checkpoint()
    edges = rows.select("part", "path").mapInArrow(_edges, "part int, first binary, last binary")  # one row a part
    edges = edges.withColumn("before", F.lag("last").over(W.orderBy("part"))).select("part", "first", "before").checkpoint()
    shared = {r["part"]: -1 for r in edges.where("before is null").select("part").collect()}
    shared |= {r["part"]: r["shared"] for r in edges.where("before is not null").mapInArrow(_meet, "part int, shared long").collect()}
    points = rows.mapInArrow(_points(shared), _POINT)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "all_words", "own_words", "n_leaves", "n_children")]
    return points.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *(F.first(c).alias(c) for c in ("depth", "parent", "ahead")))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted identifiers of a node as text."""
    node, ids = None, []
    out: list[tuple] = []

    def flush() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])
        out.clear()
        return rows

    for part in batches:
        for name, conv in zip(part.column("node").to_pylist(), part.column("conv_id").to_pylist(), strict=True):
            if name != node or len(ids) == CHUNK:
                flush()
                node = name
            ids.append(conv)
        yield batch()
    flush()
    yield batch()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's runs of identifiers, which come in their order."""
    node, h = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == node:
                h.update(b"," + ids.encode())
            else:
                done += [(node, h.hexdigest())] if h else []
                node, h = name, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the hash of the identifiers of the conversations that end at a node, in numerical order.

    A part of the range-sorted identifiers sends a node's as few rows of joined text, so that a node with many is no hot key.
    """
    ordered = paths.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    runs = ordered.mapInArrow(_join_ids, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash_ids, "node binary, ends_sha256 string")


def conversation_trie(paths: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of ``conv_id, turns`` (as conversation_paths gives them), root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (of the subtree, itself included: leaves, and words of each node times its members but
    one), ``ends_sha256`` (of the identifiers of members that end there, ascending, joined by commas).

    A conversation without turns is a member of the root only; without conversations there are no rows.  Repeated rows are
    turns of their own.  Long texts are 16 bytes here; a conversation of any length is one row of 20 bytes a turn.
    Columns besides those named are not looked at.
    """
    shared_folder(paths.sparkSession)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))
    paths = paths.withColumn("node", F.unhex(F.md5("path"))).checkpoint()
    sequences = paths.groupBy("node").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    points = _compressed(sequences).checkpoint()
    above = points.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    points = points.join(above, "parent", "left").join(_ends(paths), "node", "left")
    nodes = points.select("*", F.posexplode("ahead").alias("_at", "_ahead")).withColumn("_is_point", F.col("_at") == F.size("ahead") - 1)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(
        "conv_id", (F.col("depth") - F.size("ahead") + 1 + F.col("_at")).alias("depth"), F.when(F.col("depth") > 0, F.when(F.col("_at") == 0, F.col("_above")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs",
        F.when(F.col("_is_point"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_words") - F.col("own_words") + (F.col("n_convs") - 1) * F.col("_ahead")).alias("saved_tokens"),
        F.when(F.col("_is_point"), F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations that share the first turns of one in twenty."""
    return conversation_trie(with_shared_heads(conversation_paths(turns)))
