"""How the term frequencies of sources differ, by a cube of group blocks and term blocks.

Words are counted where the texts lie: each task counts whole texts into (lang, source, term) with occurrences and documents, and only
sums are shuffled. A lang keeps the terms of enough documents. A group (lang, source) gives each kept term a smoothed share in
billionths, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in integers.

Sums of |p - q| over all kept terms, for all pairs of groups of a lang, are worked out in a cube (Afrati and Ullman's share of a three-way product): groups
are dealt into blocks by a hash of the source, terms into blocks by a hash of the term, and a task owns a cell (group block, group block,
term block). A slice, the counts of one group block in one term block, is copied to the cells of its row and its column. A cell
holds two slices of bounded size, fills in the shares of terms that do not occur, and gives one partial sum a pair; partial sums are
added along the term axis.

Defined results: null text, lang and source are empty strings; a group without terms, or in a lang without kept terms, takes part with
its smoothed shares (with no kept terms all its sums are 0); every row is a document, repeated rows and null ids too; ties go to the smaller
item by UTF-8 bytes; a lang of one source has no pairs; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, Scratch, spans_of_bytes, text_bytes

#: Groups and terms of a block, at most in the mean; blocks of a lang's groups at least (as far as it has groups).
GROUPS, TERMS, LEAST_BLOCKS = 128, 4096, 2
#: Distinct (group, term) rows that a task holds before it passes them on.
HELD_ROWS = 1 << 18
#: Bytes of the pattern [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Pseudo-count and scale of the shares.
PSEUDO, SCALE = 5, 1_000_000_000
COUNTED = "lang string, source string, term string, n long, docs long"


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, in order, and each text's number of words."""
    inside = LETTERS[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = inside[edge]  # a text's first byte follows no other
    kept = LOWER[raw[inside]]
    place = np.cumsum(inside) - 1
    starts = np.flatnonzero(first)
    ends = np.append(place[starts], len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes()))
    return words, np.diff(np.searchsorted(starts, offsets, "left"))


def counted(langs: pa.Array, sources: pa.Array, words: pa.Array, lengths: np.ndarray) -> pa.Table:
    """(lang, source, term, n, docs) of some texts."""
    coded = words.dictionary_encode()
    term, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    pair, group = langs.dictionary_encode(), sources.dictionary_encode()
    of_doc = pair.indices.to_numpy().astype(np.int64) * len(group.dictionary) + group.indices.to_numpy()
    size = max(1, len(coded.dictionary))
    seen, times = np.unique(doc * size + term, return_counts=True)  # each document's distinct terms
    keys, inverse = np.unique(of_doc[seen // size] * size + seen % size, return_inverse=True)
    n = np.bincount(inverse, times, len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    docs = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
    of = keys // size
    columns = [pair.dictionary.take(pa.array(of // max(1, len(group.dictionary)))), group.dictionary.take(pa.array(of % max(1, len(group.dictionary)))), coded.dictionary.take(pa.array(keys % size)), pa.array(n), pa.array(docs)]
    return pa.table(columns, names=["lang", "source", "term", "n", "docs"])


def merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of some texts at a time, added up until too many distinct ones are held."""
    held, rows = [], 0
    for b in batches:
        raw, offsets = text_bytes(b.column("text"))
        for i, j in spans_of_bytes(offsets):
            words, lengths = words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            held.append(counted(b.column("lang").slice(i, j - i), b.column("source").slice(i, j - i), words, lengths))
            rows += held[-1].num_rows
            if rows >= HELD_ROWS:
                held = [merged(held)]
                rows = held[0].num_rows
            if rows >= HELD_ROWS // 2 and len(held) == 1:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if held:
        yield from merged(held).to_batches(max_chunksize=1 << 16)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PSEUDO) / (total + PSEUDO terms)), without overflow."""
    above = (count.cast("decimal(20,0)") + PSEUDO) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * PSEUDO) + 1


def cell(rows: pa.Table) -> pa.Table:
    """Partial sums of all pairs of the groups of the cell's two slices, or of its one slice on the diagonal."""
    slices, same = [], rows["row"][0] == rows["column"][0]
    for r in range(rows.num_rows if same or rows.num_rows == 2 else 0):  # of a block without groups there is no slice
        n = rows["n_terms"][r].as_py()
        base = rows["base"][r].values.to_numpy() if rows["base"][r].is_valid else np.zeros(0, np.int64)
        p = np.repeat(base[:, None], n, 1)
        if rows["entries"][r].is_valid and len(e := rows["entries"][r].values):
            p[e.field("g").to_numpy() - 1, e.field("t").to_numpy() - 1] = e.field("p").to_numpy()
        slices.append((rows["sources"][r].values, p))
    if not slices:
        return pa.table([pa.array([], pa.string())] * 3 + [pa.array([], pa.int64())], names=["lang", "source", "item", "value"])
    (a, p), (b, q) = slices[0], slices[-1]
    out = np.zeros((len(p), len(q)), np.int64)
    for i in range(len(p)):
        out[i] = np.abs(q - p[i]).sum(1)
    i, j = np.nonzero(~np.eye(len(p), dtype=bool) if same else np.ones(out.shape, bool))
    left, right, value = a.take(pa.array(i)), b.take(pa.array(j)), pa.array(out[i, j])
    if not same:
        left, right, value = pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.concat_arrays([value, value])
    lang = pa.array([rows["lang"][0].as_py()] * len(value), pa.string())
    return pa.table([lang, left, right, value], names=["lang", "source", "item", "value"])


def diverge(df: DataFrame, min_docs: int = 30, top_terms: int = 50, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    scratch = Scratch(df.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = df.select(plain("lang"), plain("source"), plain("text"))
    counts = docs.mapInArrow(count_terms, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = scratch.save(kept.select("lang", "term", "n_lang"), "kept")
    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    found = docs.select("lang", "source").distinct().join(n_terms, "lang", "left").na.fill(0, ["v", "total_lang"])
    langs = scratch.save(found.groupBy("lang", "v", "total_lang").agg(F.count(F.lit(1)).alias("n_groups")), "langs")

    # the axes: numbers of groups and terms within their blocks
    n_blocks = F.greatest(F.ceil(F.col("n_groups") / groups), F.least(F.col("n_groups"), F.lit(LEAST_BLOCKS)))
    langs = langs.select("*", n_blocks.alias("blocks"), F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).alias("term_blocks"))
    placed = kept.join(langs.select("lang", "v", "total_lang", "term_blocks"), "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), "term_blocks"))
    placed = placed.withColumn("t", F.row_number().over(W.partitionBy("lang", "term_block").orderBy("term")))
    placed = scratch.save(placed.withColumn("p_lang", share(F.col("n_lang"), F.col("total_lang"), F.col("v"))).select("lang", "term", "term_block", "t", "p_lang"), "terms")
    held = counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    group = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    group = group.withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    group = group.withColumn("g", F.row_number().over(W.partitionBy("lang", "block").orderBy("source")))
    group = scratch.save(group.select("lang", "source", "block", "g", "total", "v", "blocks", "term_blocks"), "groups")
    shares = held.join(group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    shares = scratch.save(shares.select("lang", "source", "term", "block", "g", "term_block", "t", "p", "p_lang"), "shares")

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = shares.where("p > p_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("p_lang")).alias("value"))
    high = high.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # slices: each group block in each term block, with the groups' shares of a term that does not occur
    of_block = ["lang", "block"]
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)
    rows = group.withColumn("base", absent).groupBy(*of_block, "blocks", "term_blocks").agg(F.array_sort(F.collect_list(F.struct("g", "source", "base"))).alias("x"))
    rows = rows.select(*of_block, "blocks", F.col("x.source").alias("sources"), F.col("x.base").alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block"))
    n_of = placed.groupBy("lang", "term_block").agg(F.count(F.lit(1)).alias("n_terms"))
    entries = shares.groupBy(*of_block, "term_block").agg(F.collect_list(F.struct("g", "t", "p")).alias("entries"))
    slices = rows.join(n_of, ["lang", "term_block"], "left").na.fill(0, ["n_terms"]).join(entries, [*of_block, "term_block"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    copies = scratch.save(slices, "slices").withColumn("other", other)
    cells = copies.select("lang", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("column"), "term_block", "n_terms", "sources", "base", "entries")
    partial = cells.groupBy("lang", "row", "column", "term_block").applyInArrow(cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.union(high)
