"""Exact top-k search by integer inner product with Fagin's threshold algorithm (Fagin, Lotem and Naor, 2001).

A vector stands as the integers floor(scale * x). Candidates are dealt into blocks by a hash of their content, so equal or similar
vectors cannot fill one block; each block has one list a dimension, sorted by component. A query walks a dimension's list from the large
end where its own component is positive and from the small end where it is negative, in steps that double. A candidate that turns
up is looked up in full and scored; the values where the walks stand give the most that an unseen candidate can score. The walk of a block
ends when that bound lies below the k-th score found in the block, or below the k-th score of a bounded sample of all candidates,
which the k-th of all cannot be under; equal scores go on, since a tie may have the smaller id. Nothing is approximated.

Queries are packed too, and each cell of a query block and a candidate block is one group of two rows of bounded size, so work is spread
by cells and memory does not follow the data. A cell hands on at most k candidates a query. The work is that of queries times candidates:
with queries a share of all rows it is quadratic, and in many dimensions walks see most of a block before the bound falls.

Defined results: vectors that are null, of another length than most, or hold null or non-finite components take no part, neither do null
ids; zero vectors do; rows that repeat an id are one candidate with the largest of their scores; rows that repeat a query's id are one
query with the least of their vectors; fewer than k candidates are all returned; ties go to the smaller id; a component of 2^31 or
more after scaling, or scores beyond 64 bits, are errors; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Rows of a block of candidates, and of queries, at most in the mean; bytes of either.
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 8192, 1024, 4 << 20
#: Candidates whose k-th score starts off each query; steps of the first round.
SAMPLE, STEP = 8192, 8
FOUND = "query_id long, vec_id long, score long"


def integers(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("d")).where("id is not null and d is not null")
    rows = rows.where(F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    small = lambda x: F.when(F.abs(x * scale) < 2.0**31, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return rows.select("id", F.transform("d", small).alias("v"))


def numbers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids, best first, ties to the smaller id."""
    if len(scores) > 4 * k:  # those under the k-th score cannot be among them unless ids repeat
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        if len(np.unique(ids[kept])) >= k:
            scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return scores[order], ids[order]


class Lists:
    """A block's vectors with one sorted list of rows a dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, 0)

    def top(self, q: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best candidates that score ``least`` or more."""
        n, used = len(self.ids), np.flatnonzero(q)
        seen = self.ids == own
        if not len(used):
            kept = ~seen & (least <= 0)
            return best_of(np.zeros(int(kept.sum()), q.dtype), self.ids[kept], k)
        weights, down = q[used], q[used] > 0
        scores, ids = np.zeros(0, q.dtype), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < n and not seen.all():
            to = min(n, at + step)
            here = np.where(down, self.order[n - to : n - at, used], self.order[at:to, used])
            met = np.zeros(n, bool)
            met[here.ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            score = self.x[new] @ q
            kept = score >= least
            if kept.any():
                scores, ids = best_of(np.append(scores, score[kept]), np.append(ids, self.ids[new[kept]]), k)
                if len(scores) == k:
                    least = max(least, scores[-1])
            if np.where(down, self.values[n - to, used], self.values[to - 1, used]) @ weights < least:
                break
            at, step = to, 2 * step
        return scores, ids


def packing(dim: int, key: str, more: list[str]):
    """One row (key, ids, v, ...) of a block's rows."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        v = np.ascontiguousarray(numbers(group["v"].combine_chunks(), dim))
        columns = [group[key].slice(0, 1), pa.array([ids.tobytes()]), pa.array([v.tobytes()])]
        return pa.Table.from_arrays(columns + [pa.array([group[m].to_numpy().tobytes()]) for m in more], names=[key, "ids", "v", *more])

    return pack


def scanning(dim: int, k: int):
    """The cell's candidates (left) searched for its queries (right)."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            one = lambda t, c, kind: np.frombuffer(t[c][0].as_py(), kind)
            x, q = one(left, "v", np.int64).reshape(-1, dim), one(right, "v", np.int64).reshape(-1, dim)
            most = dim * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
            if most >= 2**63:
                raise OverflowError("scores need more than 64 bits")
            kind = np.float64 if most < 2**53 else np.int64  # both exact
            lists, q = Lists(x.astype(kind), one(left, "ids", np.int64)), q.astype(kind)
            parts = []
            for own, row, least in zip(one(right, "ids", np.int64).tolist(), q, one(right, "least", np.float64).tolist(), strict=True):
                scores, ids = lists.top(row, own, least, k)
                parts.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
            found = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return scan


def floors(ids: np.ndarray, sample: np.ndarray, k: int):
    """Adds ``least``: the k-th best score of the sample's other ids, or minus infinity."""
    low = sample.astype(np.float64)

    def add(batches):
        for b in batches:
            q = numbers(b.column("v"), sample.shape[1])
            own = b.column("id").to_numpy()
            least = np.full(len(own), -np.inf)
            for i in range(0, len(own) if len(ids) > k else 0, 256):
                score = q[i : i + 256].astype(np.float64) @ low.T
                score[own[i : i + 256, None] == ids[None, :]] = -np.inf
                kth = np.partition(score, -k, 1)[:, -k]
                least[i : i + 256] = np.floor(kth - np.abs(kth) * 1e-9)  # exact below 2^53, rounded down beyond
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], names=[*b.schema.names, "least"])

    return add


def search(df: DataFrame, queries: DataFrame, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates of the highest score, never the query's own id."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = integers(df, scale, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["dim"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    asked = integers(queries, scale, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))

    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim), -(-n // (4 * partitions(spark)))))
    blocks = -(-n // most)
    mixed = F.xxhash64("id", "v")
    sample = rows.orderBy(F.xxhash64("v", "id"), "id").limit(min(SAMPLE, max(4 * k, BLOCK_BYTES // (8 * dim)))).toArrow()
    ids, one = np.unique(sample["id"].to_numpy(), return_index=True)
    vectors = numbers(sample["v"].combine_chunks(), dim)[one]

    cells = rows.withColumn("block", F.pmod(mixed, F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(packing(dim, "block", []), "block int, ids binary, v binary")
    cells = scratch.save(cells, "lists")
    asked = scratch.save(asked.mapInArrow(floors(ids, vectors, k), "id long, v array<long>, least double"), "queries")
    groups = max(1, -(-asked.count() // min(QUERY_ROWS, max(1, BLOCK_BYTES // (8 * dim)))))
    packed = asked.withColumn("ask", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("ask").applyInArrow(packing(dim, "ask", ["least"]), "ask int, ids binary, v binary, least binary")

    width = max(1, min(4 * partitions(spark), blocks * groups))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = cells.withColumn("ask", every(groups)).repartition(width, "block", "ask").groupBy("block", "ask")
    right = packed.withColumn("block", every(blocks)).repartition(width, "block", "ask").groupBy("block", "ask")
    found = left.cogroup(right).applyInArrow(scanning(dim, k), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
