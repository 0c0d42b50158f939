"""How five document filters overlap, for every order in which they can be applied.

Filters: A too few words, B too few distinct words, C too many capitals, D holds a symbol, E repeats the text of a document with a smaller id.
E comes from an existential self-join: the documents, left-semi-joined on hash and exact text with each text's smallest id, which has to
be smaller. The joined side is aggregated to one row a text before it is shuffled, so a group of copies is one row of a partial
minimum per task and the join forms no pairs; a hot hash is an equi-join that adaptive execution splits.

The documents that fail E are united with all documents and their other failures, and one aggregation by document puts a document's failures together
as the bits of a number. Counts by part and number follow: 32 numbers a part hold all that the 120 orders ask, so the orders
are worked out on counts: a filter removes, at its step, the documents that fail it and none of the filters before it.

Defined results: null texts are empty texts (no words: A fails, and E if a smaller id's text is empty or null); a null lang is the part '';
documents without an id count in their part, are never removed by E and cannot make others fail it; rows that repeat an id with another text
are told apart by text and lang, and equal rows count as many documents; an id with several labels is good (toxic) if one of them says 1; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORDS, SYMBOLS, CAPITALS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Orders in which a given one of 1, 2, ... failures comes first.
FIRST = [len(ORDERS) // m for m in range(1, len(FILTERS) + 1)]


def own_failures(text: Column, words: Column, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> Column:
    """Bits of the filters that a text fails by itself."""
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = {
        "A": n < min_words,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < n * distinct_percent,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * capital_percent,
        "D": text.rlike(SYMBOLS),
    }
    out = F.lit(0)
    for name, fail in fails.items():
        out = out.bitwiseOR(F.when(fail, BIT[name]).otherwise(0))
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, hash, text, ...) whose text a smaller doc_id has, too."""
    first = docs.where("doc_id is not null").groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("hash").alias("hash_"), F.col("text").alias("text_"), "first")
    same = (F.col("hash") == F.col("hash_")) & (F.col("text") == F.col("text_")) & (F.col("first") < F.col("doc_id"))
    return docs.join(first.hint("merge"), same, "left_semi")


def failures(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, bits, n, good, toxic): documents of each combination of failures, none included."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    key = ["doc_id", "part", "hash", F.crc32(F.col("text").cast("binary")).alias("crc"), F.octet_length("text").alias("size")]
    own = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    own = own.select(*key, own_failures(F.col("text"), F.col("words")).alias("bits"), F.lit(1).cast("long").alias("n"))
    again = repeats(docs).select(*key, F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    failed = own.union(again).groupBy("doc_id", "part", "hash", "crc", "size").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))

    marks = labels.select(F.col("doc_id").cast("long").alias("labelled"), "quality", "toxic").where("labelled is not null")
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = marks.groupBy("labelled").agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    both = failed.select("doc_id", "part", "bits", "n").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return both.groupBy("part", "bits").agg(F.sum("n").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders, from the counts of ``failures``.

    A part's counts are at most 32 numbers, taken together as one array.
    """
    held = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    every = held.select("part", "cells", F.explode(F.lit(ORDERS)).alias("filter_order"))
    every = every.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    code = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord(FILTERS[0]))
    before = F.aggregate(F.split(F.expr("substring(filter_order, 1, at)"), ""), F.lit(0), lambda bits, c: bits + F.when(c == "", 0).otherwise(code(c)))
    every = every.select("part", "cells", "filter_order", (F.col("at") + 1).cast("int").alias("step"), code(F.col("letter")).alias("own"), before.alias("before"))
    fails, earlier = (lambda c: c["bits"].bitwiseAND(F.col("own")) != 0), (lambda c: c["bits"].bitwiseAND(F.col("before")) != 0)
    total = lambda test, value: F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(test(c), value(c)).otherwise(0).cast("long"))
    n = lambda c: c["n"]
    here = lambda c: fails(c) & ~earlier(c)
    return every.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~earlier(c), n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda c: fails(c) & earlier(c), n).alias("redundant"),
        total(lambda c: c["bits"] == F.col("own"), n).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # each of a document's failures comes first in as many of the orders
        total(fails, lambda c: c["n"] * F.element_at(F.lit(FIRST), F.bit_count(c["bits"]))).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    return orders(Scratch(df.sparkSession).save(failures(df, labels), "failures"))
