"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, where the largest cosine is the smallest distance.  In each of ``tables`` hash tables
a vector falls into the bucket of ``hashes`` values floor((a.v + b) / width) with Gaussian a.  For a neighbour at distance r the
difference of a projection is normal with deviation r, which gives the chance that it lies in the query's own bucket or in one
perturbed by a step in some of the values.  Buckets are visited in the order of that chance, until the chances of all tables
together reach ``success``.  The distance is first estimated from the best buckets of one table, so a query with near
neighbours visits few buckets and one without visits many.  The rows of the visited buckets of all tables are reranked by
exact cosine in double precision.

Equal vectors form one class that carries its smallest identifiers only, as many as any answer can use, so a vector that
a third of all rows share is one row of the index.  Buckets that share their first values form a group; a row of the index
travels once for each table, a query once for each group that it visits, with the list of its buckets there.  A group with
many rows is dealt over several parts: each part of its rows meets each part of its queries.  Queries with fewer finds
than there are candidates to ask for are answered by an exact scan in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as tx
from .session import shared_folder

BUCKET_ROWS = 20_000
#: Index and queries of one group: the bucket of a row, or the buckets that a query visits.
_ROW = "key long, no long, vector binary, ids array<long>, buckets array<long>"
_erf = np.frompyfunc(math.erf, 1, 1)


def _planes(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(dim * 7919 + 11)
    return g.standard_normal((dim, tables * hashes)), g.random(tables * hashes) * width


def _keys(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit key of each row (last axis) of bucket coordinates."""
    h = np.full(cells.shape[:-1], (table * 0x9E3779B97F4A7C15 + dim) % 2**64, np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cells[..., j].astype(np.int64).view(np.uint64)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def chances(below: np.ndarray, distance: np.ndarray, width: float) -> np.ndarray:
    """For each query and hash the chance that a neighbour at a distance lies one cell lower, in the same, one cell higher.

    ``below`` holds each projection's distance from the lower border of its cell.
    """
    edges = np.stack([-below - width, -below, width - below, 2 * width - below], -1) / np.maximum(distance, 1e-6)[:, None, None]
    return np.maximum(np.diff(0.5 * (1 + _erf(edges / math.sqrt(2)).astype(float)), axis=-1), 1e-30)


def steps(hashes: int) -> np.ndarray:
    """All perturbations: a row of -1, 0 or 1 for each hash."""
    return np.stack(np.meshgrid(*[[-1, 0, 1]] * hashes, indexing="ij"), -1).reshape(-1, hashes)


def visits(below: np.ndarray, distance: np.ndarray, width: float, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and perturbation of every visit, best first for each query, until the chances add up to ``enough`` (or run out)."""
    all_steps = steps(below.shape[1])
    logs = np.log(chances(below, distance, width))
    total = sum(logs[:, j, all_steps[:, j] + 1] for j in range(below.shape[1]))
    order = np.argsort(-total, axis=1, kind="stable")
    sums = np.cumsum(np.exp(np.take_along_axis(total, order, 1)), axis=1)
    count = np.minimum((sums < enough).sum(1) + 1, len(all_steps))
    owner = np.repeat(np.arange(len(below)), count)
    return owner, all_steps[order[np.arange(len(all_steps))[None, :] < count[:, None]]]


def _unit(part: pa.RecordBatch, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a batch, for each dimension."""
    raw = part.column("vector").to_pylist()
    size = np.array([len(v) for v in raw])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(raw[i] for i in rows), dtype).reshape(len(rows), -1).astype(np.float64)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _emit(part: pa.RecordBatch, rows: np.ndarray, key: np.ndarray, buckets: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    take = part.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([pa.array(key), take.column("no"), take.column("vector"), take.column("ids"), tx.list_column(buckets, lengths, pa.int64())], ["key", "no", "vector", "ids", "buckets"])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rerank(batches: Iterator[pa.RecordBatch], k: int, dtype: type) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by (key, part, side): the k best finds of each query (side 0) in the rows (side 1) of its buckets.

    A query without buckets looks at all rows.  A find without vec_id says in its score how many rows were looked at.
    """
    group, queries, rows = None, [], []

    def best() -> Iterator[pa.RecordBatch]:
        if not queries or not rows or len({len(r[0]) for r in (*queries[:1], *rows[:1])}) > 1:
            return
        rows.sort(key=lambda r: r[2])
        q, v = (np.frombuffer(b"".join(r[0] for r in x), dtype).reshape(len(x), -1).astype(np.float64) for x in (queries, rows))
        bucket = np.array([r[2] for r in rows])
        qn, vn = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        unit, out = v / vn[:, None], ([], [], [])
        for i, (_, no, wanted) in enumerate(queries):
            if len(wanted):
                begin, end = np.searchsorted(bucket, wanted, "left"), np.searchsorted(bucket, wanted, "right")
                some = np.flatnonzero(end > begin)
                seen = np.concatenate([np.arange(begin[j], end[j]) for j in some]) if len(some) else np.zeros(0, np.int64)
            else:
                seen = np.arange(len(rows))
            if not len(seen):
                continue
            line = (unit if len(seen) == len(rows) else unit[seen]) @ (q[i] / qn[i])
            # all rows that could be among the k best, give or take rounding
            edge = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -2.0
            at = seen[np.flatnonzero(line >= edge - 1e-12)]
            exact = np.minimum(1.0, np.maximum(-1.0, (v[at] * q[i]).sum(1) / (vn[at] * qn[i])))
            found = sorted((-s, vec_id) for s, j in zip(exact.tolist(), at.tolist(), strict=True) for vec_id in rows[j][1])[:k]
            out[0].extend([no] * (len(found) + 1))
            out[1].extend([*(f[1] for f in found), None])
            out[2].extend([*(-f[0] for f in found), float(len(seen))])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["no", "vec_id", "score"])

    for batch in batches:
        for key, part, side, no, vector, ids, buckets in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "side", "no", "vector", "ids", "buckets")), strict=True):
            if (key, part) != group:
                yield from best()
                group, queries, rows = (key, part), [], []
            if side == 0:
                queries.append((vector, no, np.array(buckets, np.int64)))
            elif queries:
                rows.append((vector, ids, buckets[0] if buckets else 0))
    yield from best()


def _meet(probes: DataFrame, index: DataFrame, k: int, bucket_rows: int, dtype: type) -> DataFrame:
    """``no, vec_id, score``: for each query the k best rows of the index in the groups it visits, see _rerank()."""
    counts = index.groupBy("key").agg(F.count("*").alias("n")).join(probes.groupBy("key").agg(F.count("*").alias("m")), "key")
    large = counts.where((F.col("n") > bucket_rows) | (F.col("m") > bucket_rows)).select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("_n"), F.ceil(F.col("m") / bucket_rows).cast("int").alias("_m")).checkpoint()
    some = not large.isEmpty()

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        rows = rows.join(large, "key", "left") if some else rows.withColumns({"_n": F.lit(1), "_m": F.lit(1)})
        rows = rows.withColumn("_own", F.pmod(F.xxhash64("no"), F.coalesce(F.col(own), F.lit(1))).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        across = F.coalesce(F.col("_m"), F.lit(1))
        part = F.col("_own") * across + F.col("_other") if side else F.col("_other") * across + F.col("_own")
        return rows.select("key", part.alias("part"), F.lit(side).alias("side"), "no", "vector", "ids", "buckets")

    both = dealt(probes, 0, "_m", "_n").unionByName(dealt(index, 1, "_n", "_m"))
    together = both.repartition("key", "part").sortWithinPartitions("key", "part", "side")
    return together.mapInArrow(lambda b: _rerank(b, k, dtype), "no long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.where("vec_id is not null").groupBy("no", "vec_id").agg(F.max("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: F.Column, *, k: int = 5, **how) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query, from columns ``vec_id, embedding``.

    ``is_query`` says which rows ask; all rows but a query's own identifier may answer.  Nearness is the cosine, ties go to
    the smaller identifier; there are k answers unless there are fewer candidates.  Null vectors, zero vectors and those
    with null or non-finite components take no part; vectors of different dimensions never meet; repeated rows count
    once; an empty table gives an empty result; columns besides the two are not looked at unless ``is_query`` does.
    Further parameters are those of search().
    """
    return search(vectors, is_query, k=k, **how)[0]


def search(vectors: DataFrame, is_query: F.Column, *, k: int = 5, tables: int = 4, hashes: int = 6, width: float = 1.3, success: float = 0.97, first_success: float = 0.15, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The answers of nearest(), and ``no, visited``: how many rows each distinct query vector was compared with.

    ``success`` is the estimated chance that a neighbour is in a visited bucket of any table, ``first_success`` that of the
    first look into one table (at an assumed distance of 1), which gives the distance of the k-th neighbour found.
    """
    spark = vectors.sparkSession
    shared_folder(spark)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype = np.float32 if single else np.float64  # as given: the cosine is computed in double precision either way
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks"))
    first = W.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k + 1)
    pack = lambda b: _pack(b, dtype)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).mapInArrow(pack, "no long, vector binary, ids array<long>").checkpoint()
    asking = rows.where("asks").select("vec_id", "embedding")
    askers = asking.groupBy("embedding").agg(F.min("vec_id").alias("no"))
    asked = askers.select("embedding", "no", F.array("no").alias("ids")).mapInArrow(pack, "no long, vector binary, ids array<long>").checkpoint()
    n_classes = classes.count()
    # as many leading values of a bucket name its group as make groups of about bucket_rows
    lead = min(hashes, max(1, math.ceil(math.log(max(1, n_classes / bucket_rows), 3))))

    def cells(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = _planes(x.shape[1], tables, hashes, width)
        own = slice(t * hashes, (t + 1) * hashes)
        place = x @ a[:, own] + b[own]
        whole = np.floor(place / width).astype(np.int64)
        return whole, place - whole * width

    def index(used: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _pieces(batches, 2048):
                for at, x in _unit(part, dtype):
                    for t in used:
                        whole, _ = cells(x, t)
                        yield _emit(part, at, _keys(whole[:, :lead], t, x.shape[1]), _keys(whole, t, x.shape[1]), np.ones(len(x), np.int64))

        return run

    def probe(used: range, enough: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _pieces(batches, 256):
                distance = part.column("distance").to_numpy(zero_copy_only=False)
                for at, x in _unit(part, dtype):
                    for t in used:
                        whole, below = cells(x, t)
                        owner, step = visits(below, distance[at], width, enough)
                        visited = whole[owner] + step
                        key, bucket = _keys(visited[:, :lead], t, x.shape[1]), _keys(visited, t, x.shape[1])
                        order = np.lexsort((bucket, key, owner))
                        owner, key, bucket = owner[order], key[order], bucket[order]
                        edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
                        yield _emit(part, at[owner[edge]], key[edge], bucket, np.diff(np.append(edge, len(owner))))

        return run

    near = _meet(asked.withColumn("distance", F.lit(1.0)).mapInArrow(probe(range(1), first_success), _ROW), classes.mapInArrow(index(range(1)), _ROW), k + 1, bucket_rows, dtype).checkpoint()
    # the k-th find besides the query itself; without so many finds a distance that is almost a right angle's
    kth = _best(near, k + 1).groupBy("no").agg(F.when(F.count("*") > k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).alias("_r"))
    aware = asked.join(kth, "no", "left").withColumn("distance", F.coalesce("_r", F.lit(1.3)))
    everywhere = _meet(aware.mapInArrow(probe(range(tables), 1 - (1 - success) ** (1 / tables)), _ROW), classes.mapInArrow(index(range(tables)), _ROW), k + 1, bucket_rows, dtype).checkpoint()
    met = near.unionByName(everywhere)
    found = _best(met, k + 1).checkpoint()
    visited = met.where("vec_id is null").groupBy("no").agg(F.sum("score").cast("long").alias("visited"))
    # an answer short of k + 1 rows (the query itself is one) may be short of candidates: scan all rows for it
    full = found.groupBy("no").agg(F.count("*").alias("n")).where(F.col("n") > k)
    short = asked.join(full, "no", "left_anti").checkpoint()
    if not short.isEmpty():
        parts = max(1, -(-n_classes // bucket_rows))
        block = lambda part: F.xxhash64(F.length("vector"), part)  # noqa: E731  vectors of one dimension only
        nothing = F.expr("cast(array() as array<long>)").alias("buckets")
        spread = short.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(block(F.col("_part")).alias("key"), "no", "vector", "ids", nothing)
        own = classes.select(block(F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int")).alias("key"), "no", "vector", "ids", nothing)
        scanned = _meet(spread, own, k + 1, bucket_rows, dtype)
        found = _best(found.select("no", "vec_id", "score").unionByName(scanned), k + 1)
    owners = asking.join(askers, "embedding").select(F.col("vec_id").alias("query_id"), "no")
    answers = owners.join(found.select("no", "vec_id", "score"), "no").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), visited


def _pack(batches: Iterator[pa.RecordBatch], dtype: type) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; a class without a number gets its smallest identifier."""
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        no = batch.column("no").to_pylist() if "no" in batch.schema.names else [i[0] for i in ids]
        raw = [np.array(v, dtype).tobytes() for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(raw, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["no", "vector", "ids"])


def neighbours_report(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest rows found for every row whose identifier is divisible by 50."""
    return nearest(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
