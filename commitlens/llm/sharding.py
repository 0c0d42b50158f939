"""Contiguous, byte-balanced shards from global prefix sums.

The rows are laid out in id order over range partitions. Each partition contributes one total of bytes and rows; the running sums
of those totals are the partitions' offsets, and offset plus running sum inside the partition is a row's place among all bytes.
Cutting that line at equal targets gives contiguous shards whose sizes differ by at most one row. Only built-in functions are used.

Defined results: a null text counts no bytes (its crc is 0) and still takes a slot; a null id sorts first; rows that repeat an id
are ordered by their text's checksum and size, and equal rows take neighbouring slots in any order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, saved


def byte_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1; ``shard`` is in [0, shards); ``slot`` numbers a shard's rows from 0 without gaps,
    in id order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["id", "text_crc32", "size"]
    # written once: the range bounds are drawn from a sample, so a second evaluation could cut elsewhere
    placed = saved(rows.repartitionByRange(partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id()), "shards")

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition, not per document
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(whole).alias("bytes_all"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    at = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(F.broadcast(offsets), "part")  # as many rows as there are shuffle partitions
        .withColumn("middle", (F.col("bytes_before") + F.col("upto") - F.col("size")).cast("decimal(38,0)") * 2 + F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(middle * {shards}) div (2 * cast(bytes_all as decimal(20,0)))").cast("int")))
        .select("part", "id", "size", "text_crc32", "shard", *[])
    )
    # slots: rows of the shard in earlier partitions, plus the row's number among the partition's rows of the shard
    pieces = at.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    starts = pieces.select("part", "shard", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    number = F.row_number().over(W.partitionBy("part", "shard").orderBy(*order))
    return (
        at.withColumn("number", number)
        .join(F.broadcast(starts), ["part", "shard"])  # at most partitions + shards rows
        .select("id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("number") - 1).alias("slot"))
    )
