"""Shared helpers: checkpoint folder, partition counts, word scans over Arrow buffers, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step holds at once; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's. A temporary folder only where everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut the lineage of a job of several steps. Spent ones are deleted before the job goes on."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, tuple[str, StructType]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as Parquet and reads them back. A name that is used again stands for the newer table."""
        schema, path = df.schema, new_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path, schema
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more. No query runs for it, so the driver keeps no plan of one either."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name)[0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet in the shared folder and reads them back."""
    return Scratch(df.sparkSession).save(df, name)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``saved``, bucketed by ``key`` into as many buckets as shuffle partitions: a join by the key does not shuffle these rows again.

    Only a table can be bucketed; its entry leaves the catalog at once, as the rows that are read back know its files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(partitions(spark), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table `{table}`")  # of an outside folder, which stays
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(docs: DataFrame, most: int, text: str = "text") -> int:
    """So many buckets that each one's share of all texts is about ``most`` bytes; as many as shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // most))


def plain_string_array(column) -> pa.Array:
    """One contiguous string array with 32-bit offsets; nulls become empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the len+1 offsets of the texts in them."""
    a = plain_string_array(column)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans_of_bytes(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs [i, j) of texts whose bytes stay within ``most``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and, for each text, the number of the first word at or after it (len+1).

    ``in_word`` is a table of 256 booleans. No word crosses from one text to the next.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = in_word[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


#: Odd multiplier of the byte and word hashes, which are polynomials modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the worker's later batches."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            out = []
            for b in (base, inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of values[start:end] for all ranges, from one prefix sum."""
    up, down = powers(len(values) + 1, base)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * down[starts]


#: Longer words are hashed by themselves: modulo 2**64 any base has long structured words that collide.
LONG_WORD, PIECE_BYTES = 256, 1 << 18


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # some bytes at a time, as their hashes are eight times as wide
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        a = starts[i]
        h[i:j] = range_hashes(raw[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    with np.errstate(over="ignore"):
        h = mix(h + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def byte_table(pattern_bytes: set[int], inside: bool) -> np.ndarray:
    t = np.full(256, not inside)
    t[list(pattern_bytes)] = inside
    return t


#: Words of the pattern [^\x20\x09-\x0D]+ on UTF-8 bytes.
NOT_SPACE = byte_table({0x20, *range(0x09, 0x0E)}, False)
#: Words of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing) on UTF-8 bytes.
LETTER_OR_DIGIT = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}, True)
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**28 as 7-bit groups, low group first, the high bit on all but a number's last byte."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        has = size > k
        more = (size > k + 1).astype(np.int64) << 7
        out[(end - size + k)[has]] = (((numbers >> (7 * k)) & 127) | more)[has]
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    end = np.flatnonzero(last)
    start = np.append(0, end[:-1] + 1)
    out = np.zeros(len(end), np.int64)
    for k in range(4):
        has = start + k <= end
        out[has] |= (raw[(start + k)[has]].astype(np.int64) & 127) << (7 * k)
    return out


def sha256_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def text_key(text: str = "text") -> Column:
    """Tells apart rows that repeat an id, or have none, with another text."""
    return F.xxhash64(F.col(text))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text): only the columns in use."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node on an edge.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until nothing changes, so the number of rounds grows
    with the logarithm of the longest path. Each round aggregates neighbours to their minimum before they are joined again, and is
    written to the shared folder; the round before it goes.
    """
    e = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    round_ = 0
    while True:
        # large-star: each larger neighbour of u links to the least of u's neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").distinct()
        # small-star: u and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("m").alias("r"))
        small = large.join(least, "u").select(F.explode(F.array_distinct(F.array("u", "m"))).alias("a"), F.col("r").alias("b")).where("a <> b").distinct()
        n = scratch.save(small, f"{name}-{round_ + 1}")
        scratch.drop(f"{name}-{round_}")
        e, round_ = n, round_ + 1
        # a star forest: every node has one parent and no parent has one
        several = n.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count()
        if not several and not n.join(n.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
