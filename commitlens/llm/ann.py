"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling (Gao and Long, 2023).

Largest inner product becomes nearest distance by one more coordinate: x gets sqrt(M^2 - |x|^2), a query gets 0, so
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>. Lists are cells of centroids that are fitted on a bounded sample of vectors.

Vectors are rotated at random and scanned in column blocks. Within a probed list a query's partial distances grow block by block; after d
of D coordinates a candidate is abandoned if its partial distance, scaled by D/d, exceeds the query's limit by more than the test's
confidence bound (1 + e/sqrt(d)). The limit is the distance of the k-th best vector of the bounded sample in the probed lists, so the k-th best
of all vectors there is no farther. Only survivors' inner products are computed in double precision from the original vectors.

Vectors are packed into blocks of one list each, so a list that holds a third of all vectors is many blocks. A block travels once, to the
task that scans it; queries are sent to each block of the lists they probe. Each task gives its best k of each query; the last step
ranks a query's few candidates.

The number of lists is the square root of the number of vectors up to LISTS, so the work of a query grows with that root, and beyond
LISTS squared vectors with their number.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a null id takes no part;
rows that repeat an id are one candidate with the largest of their scores; rows that repeat a query's id are one query with the least of
their vectors; fewer than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Vectors that the centroids are fitted on, and those of them that give a query's limit, at most.
SAMPLE, LIMIT_SAMPLE = 20_000, 8192
#: Lists, at most; below that their number is the square root of the number of vectors.
LISTS = 4096
#: A query probes as many lists as find this share of the nearest of TUNING sample vectors within the sample. In the whole table
#: neighbours are nearer than in a sample.
RECALL, TUNING = 0.95, 256
#: Vectors in a block; queries in one row; tasks whose last, unfilled blocks of a list become common ones.
BLOCK_ROWS, QUERY_ROWS, TASKS = 2048, 512, 64
#: Entries that a task combines before it passes them on, and pairs that are measured in full at once.
HELD_ROWS, PAIRS = 400_000, 1 << 17
#: Coordinates of a column block, and e of the test: a true neighbour is abandoned with probability below about 2 exp(-e^2 / 2).
COLUMNS, CONFIDENCE = 16, 2.1


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(ok)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    square = (c**2).sum(1)
    return np.concatenate([np.argmin(square - 2 * x[i : i + 2048] @ c.T, 1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_of(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Centroids, the rotation and the sample for limits, fitted once; of fixed size (at most LISTS centroids, LIMIT_SAMPLE vectors)."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, largest: float, n: int, k: int, seed: int = 3):
        self.dim, self.largest, self.k = sample.shape[1], largest, k
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim + 1, self.dim + 1)))[0]
        self.centroids = kmeans(self.lift(sample), int(min(LISTS, max(1, round(n**0.5)))))
        self.ids, one = np.unique(ids[:LIMIT_SAMPLE], return_index=True)
        self.sample, self.home = sample[one], nearest_of(self.lift(sample[one]), self.centroids)
        q = sample[:TUNING]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1) - 1, 1)[:, :k] if len(sample) > 1 else np.zeros((len(q), 1), int)
        home = nearest_of(self.lift(sample), self.centroids)
        order = np.argsort(np.argsort(self.distances(self.lift_query(q)), 1), 1)  # each list's place in a query's probing
        needed = np.sort(np.take_along_axis(order, home[near], 1).ravel()) + 1
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.largest**2 - (x**2).sum(1), 0))[:, None]]) @ self.rotation

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def limits(self, query_ids: np.ndarray, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """For each query a squared distance that its k-th best candidate does not exceed: that of the sample in the probed lists."""
        if len(self.ids) <= self.k:
            return np.full(len(q), np.inf)
        asks = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(asks, probed, True, 1)
        score = np.where(asks[:, self.home], q @ self.sample.T, -np.inf)
        at = np.minimum(np.searchsorted(self.ids, query_ids), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[at] == query_ids)
        score[own, at[own]] = -np.inf
        best = np.partition(score, -self.k, 1)[:, -self.k]
        whole = (q**2).sum(1) + self.largest**2
        return np.where(np.isfinite(best), whole - 2 * best + 1e-9 * whole, np.inf)


PACKED = pa.schema([("list", pa.int32()), ("salt", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])


class Packer:
    """Collects vectors by list and gives them out as rows of about BLOCK_ROWS."""

    def __init__(self):
        self.held: dict[int, list[tuple[bytes, bytes]]] = {}

    def add(self, k: int, ids: bytes, vectors: bytes) -> bool:
        """Whether the list has enough for a row."""
        parts = self.held.setdefault(k, [])
        parts.append((ids, vectors))
        return sum(len(p[0]) for p in parts) >= 8 * BLOCK_ROWS

    def row(self, k: int, salt: int) -> dict:
        parts = self.held.pop(k)
        return {"list": k, "salt": salt, "ids": b"".join(p[0] for p in parts), "vectors": b"".join(p[1] for p in parts)}


def _pack(index):
    """Vectors by list. Full rows are salted at random; what is left at a task's end meets that of TASKS tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        packer = Packer()
        for b in batches:
            x, ids, full = matrix(b.column("v"), ix.dim), b.column("id").to_numpy(), []
            near = nearest_of(ix.lift(x), ix.centroids)
            for k in np.unique(near).tolist():
                mine = np.flatnonzero(near == k)
                for i in range(0, len(mine), BLOCK_ROWS):
                    some = mine[i : i + BLOCK_ROWS]
                    if packer.add(k, ids[some].astype("<i8").tobytes(), x[some].astype("<f8").tobytes()):
                        full.append(packer.row(k, uuid.uuid4().int >> 66))
            yield pa.RecordBatch.from_pylist(full, PACKED)
        context = TaskContext.get()
        yield pa.RecordBatch.from_pylist([packer.row(k, -1 - context.partitionId() // TASKS) for k in list(packer.held)], PACKED)

    return pack


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by list and salt: those of one list become blocks."""
    schema = pa.schema([("block", pa.int64()), *list(PACKED)])
    packer, last = Packer(), None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if last is not None and last != row["list"] and last in packer.held:
                out.append({"block": uuid.uuid4().int >> 65, **packer.row(last, 0)})
            last = row["list"]
            if packer.add(last, row["ids"], row["vectors"]):
                out.append({"block": uuid.uuid4().int >> 65, **packer.row(last, 0)})
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([{"block": uuid.uuid4().int >> 65, **packer.row(k, 0)} for k in list(packer.held)], schema)


def _probe(index):
    schema = pa.schema([("list", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("limits", pa.binary())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for b in batches:
            x, ids = matrix(b.column("v"), ix.dim), b.column("id").to_numpy()
            for i in range(0, len(x), QUERY_ROWS):
                q, qi, rows = x[i : i + QUERY_ROWS], ids[i : i + QUERY_ROWS], []
                probed = np.argpartition(ix.distances(ix.lift_query(q)), ix.probes - 1, 1)[:, : ix.probes]
                limits = ix.limits(qi, q, probed)
                of = np.repeat(np.arange(len(q)), ix.probes)
                order = np.argsort(probed.ravel(), kind="stable")
                lists = probed.ravel()[order]
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(lists) > 0)))
                for k, mine in zip(lists[cuts].tolist(), np.split(of[order], cuts[1:]), strict=True):
                    rows.append({"list": k, "ids": qi[mine].astype("<i8").tobytes(), "vectors": q[mine].astype("<f8").tobytes(), "limits": limits[mine].astype("<f8").tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return probe


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best candidates, each id once; ties go to the smaller id."""
    order = np.lexsort((-score, vec, query))
    order = order[np.concatenate(([True], (np.diff(query[order]) != 0) | (np.diff(vec[order]) != 0)))] if len(order) else order
    order = order[np.lexsort((vec[order], -score[order], query[order]))]
    sorted_query = query[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_query[1:] != sorted_query[:-1]))) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def scan(q: np.ndarray, q_lifted: np.ndarray, query_ids: np.ndarray, limits: np.ndarray, ids: np.ndarray, x: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the pairs of a block's rows and some queries that the test lets through, in parts.

    Partial distances of all pairs grow column block by column block while many are left, then those of the single pairs.
    """
    dims = sum(c.shape[1] for c in columns)
    bound = lambda done: 1.0 if done == dims else done / dims * (1 + CONFIDENCE / np.sqrt(done)) ** 2
    partial, done, used, keep = np.zeros((len(x), len(q))), 0, 0, None
    for c in columns:
        ask = q_lifted[:, done : done + c.shape[1]]
        partial += (c @ ask.T) * -2
        partial += (c**2).sum(1)[:, None]
        partial += (ask**2).sum(1)
        done, used = done + c.shape[1], used + 1
        keep = partial <= limits * bound(done)
        if np.count_nonzero(keep) * 16 < keep.size:
            break
    keep &= ids[:, None] != query_ids
    row, query = np.nonzero(keep)
    far = partial[row, query]
    for c in columns[used:]:
        ask = q_lifted[:, done : done + c.shape[1]]
        done += c.shape[1]
        for i in range(0, len(row), PAIRS):
            part = slice(i, i + PAIRS)
            far[part] += ((c[row[part]] - ask[query[part]]) ** 2).sum(1)
        near = far <= limits[query] * bound(done)
        row, query, far = row[near], query[near], far[near]
    for i in range(0, len(row), PAIRS):
        r, p = row[i : i + PAIRS], query[i : i + PAIRS]
        yield p, r, np.einsum("ij,ij->i", x[r], q[p])


def _search(index, k: int):
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, the vectors of a block before the queries that ask it."""
        ix: Index = index.value
        block, kept = None, None
        held: list[tuple[np.ndarray, ...]] = []

        def reduced() -> tuple[np.ndarray, ...]:
            query, vec, score = (np.concatenate(c) for c in zip(*held, strict=True))
            best = best_of(query, vec, score, k)
            return query[best], vec[best], score[best]

        def batch(columns):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for b in batches:
            for row in range(b.num_rows):
                number, ids, vectors, limits = (b.column(c)[row].as_py() for c in ("block", "ids", "vectors", "limits"))
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, ix.dim)
                if limits is None:
                    lifted = ix.lift(x)
                    block, kept = number, (ids, x, [np.ascontiguousarray(lifted[:, i : i + COLUMNS]) for i in range(0, lifted.shape[1], COLUMNS)])
                    continue
                if block != number:
                    raise ValueError("queries came without their block")
                for query, found, score in scan(x, ix.lift_query(x), ids, np.frombuffer(limits, "<f8"), *kept):
                    best = best_of(query, kept[0][found], score, k)
                    held.append((ids[query[best]], kept[0][found[best]], score[best]))
                    if sum(len(h[0]) for h in held) > HELD_ROWS:  # one task's entries of a query are combined before they are dealt on
                        held = [reduced()]
                        if len(held[0][0]) > HELD_ROWS // 2:
                            yield batch(held[0])
                            held = []
        if held:
            yield batch(reduced())

    return search


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest rows of ``df`` but itself that the probed lists hold."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, largest = lengths[0]["d"], lengths[0]["n"], float(lengths[0]["m"]) ** 0.5
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    ids, vectors = sample.column("id").to_numpy(), matrix(sample.column("v").combine_chunks(), dim)
    index = spark.sparkContext.broadcast(Index(ids, vectors, largest, n, k))

    parts = partitions(spark)
    packed = rows.mapInArrow(_pack(index), "list int, salt long, ids binary, vectors binary").repartition(parts, "list", "salt").sortWithinPartitions("list", "salt")
    blocks = Scratch(spark).save(packed.mapInArrow(_blocks, "block long, list int, salt long, ids binary, vectors binary"), "blocks")
    once = usable(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = once.mapInArrow(_probe(index), "list int, ids binary, vectors binary, limits binary").join(blocks.select("list", "block"), "list")
    both = blocks.select("block", "ids", "vectors", F.lit(None).cast("binary").alias("limits")).union(asked.select("block", "ids", "vectors", "limits"))
    both = both.repartition(parts, "block").sortWithinPartitions("block", F.col("limits").isNotNull())
    found = both.mapInArrow(_search(index, k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
