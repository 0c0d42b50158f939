"""Benchmark decontamination with an FM-index per training shard.

A shard is some MB of training text inside one task. Its words become codes: the words of the test windows get numbers, all others
are separators, and runs between separators that are too short for any window are left out (they cannot hold one). Over that sequence
the shard's FM-index is built; all test windows are searched backwards at once through wavelet-tree ranks, their occurrences located by
sampled suffix positions, compared word by word with the training text, and merged to removal spans per document.

The test items come in parts of at most PART_WORDS words. A benchmark of one part is searched in a single pass over the training table, which
is never shuffled. A larger one takes a pass for each part; the hits of a part are written, one row for each distinct text that has any, before
the next part is sent, and the hits of all parts are joined to the rows in the end. So driver and executors hold one part at a time, however
large the benchmark is. All parts are searched in the input texts, not in what another part left.

Defined results: null and empty texts have no words and no hits; null test items are skipped; repeated item ids count once; repeated
rows are each judged alone; with no test items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER_OR_DIGIT, LOWER, saved, spans_of_bytes, text_bytes, word_hashes, word_spans
from .fm_index import FMIndex

#: Text of one shard.
SHARD_BYTES = 4 << 20
#: Words of test items searched at once; more items go in further parts.
PART_WORDS = 2_000_000
#: What tells texts apart where the hits of several parts meet: two hashes and the size.
KEY_NAMES = ("_xxhash", "_crc", "_size")
HITS = {"spans": "array<array<long>>", "items": "array<string>"}
SPANS = "_benchmark_spans"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text)]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of characters other than ASCII without letters and digits."""
    return WORD.findall((text or "").encode().lower())


class Windows:
    """The distinct windows of some test items, as codes, and the items each belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if not words or item is None:
                continue
            codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for i in range(max(1, len(codes) - width + 1)):
                windows.setdefault(tuple(codes[i : i + width]), set()).add(str(item))
        self.words = [b"", *vocabulary]
        self.levels = max(1, int(len(vocabulary)).bit_length())
        self.items = [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), width), np.int64)
        for i, w in enumerate(windows):
            self.patterns[i, width - len(w) :] = w
        self.shortest = int(self.lengths.min(initial=width))
        joined = b" ".join(self.words[1:])
        raw = np.frombuffer(joined, np.uint8)
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), LETTER_OR_DIGIT)
        h = word_hashes(raw, starts, ends) if len(raw) else np.zeros(0, np.uint64)
        # symbols stand for hashes: words that share one share a symbol, and the comparison of found words tells them apart
        self.hashes, symbol = np.unique(h, return_inverse=True)
        self.symbols = np.concatenate(([0], symbol + 1))[self.patterns]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words by their hashes; 0 for words of no test item."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


def shard_hits(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_at: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word number, window number) of all occurrences of windows in the texts of one shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts) or not len(w.lengths):
        return none
    codes = w.encode(word_hashes(part, starts, ends))
    # the word numbers of the index's symbols, -1 for separators; a text's first word is always behind a separator
    text_of = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    known = np.flatnonzero(codes)
    if not len(known):
        return none
    new_run = np.concatenate(([True], (np.diff(known) > 1) | (np.diff(text_of[known]) > 0)))
    run = np.cumsum(new_run) - 1
    enough = np.bincount(run)[run] >= w.shortest
    known, new_run = known[enough], new_run[enough]
    if not len(known):
        return none
    at = np.arange(len(known)) + np.cumsum(new_run)
    text = np.zeros(at[-1] + 2, np.int64)
    number = np.full(len(text), -1, np.int64)
    text[at], number[at] = codes[known], known

    index = FMIndex(text, w.levels)
    lo, hi = index.search(w.symbols, w.lengths)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    found = number[index.locate(places)]
    # equal hashes are no proof: the words themselves decide
    good = np.array([
        all(part[starts[p + i] : ends[p + i]].tobytes() == w.words[c] for i, c in enumerate(w.patterns[k, w.patterns.shape[1] - w.lengths[k] :]))
        for p, k in zip(found.tolist(), which.tolist(), strict=True)
    ], bool)
    return found[good], which[good]


def merge(spans: list) -> list[list[int]]:
    """Overlapping and touching [from, to) ranges as one."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _search(windows):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            old_spans, old_items = ([x or [] for x in b.column(c).to_pylist()] for c in ("spans", "items"))
            for i, j in spans_of_bytes(offsets, SHARD_BYTES):
                part, off = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                starts, ends, word_at = word_spans(part, off, LETTER_OR_DIGIT)
                found, which = shard_hits(part, starts, ends, word_at, w)
                order = np.argsort(found, kind="stable")
                found, which = found[order], which[order]
                cut = np.searchsorted(found, word_at)
                spans, items = [], []
                for k in range(j - i):
                    mine, of = found[cut[k] : cut[k + 1]] - word_at[k], which[cut[k] : cut[k + 1]]
                    spans.append(merge([*old_spans[i + k], *zip(mine.tolist(), (mine + w.lengths[of]).tolist(), strict=True)]))
                    items.append(sorted({*old_items[i + k], *(x for v in of.tolist() for x in w.items[v])}))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", "text")), pa.array(np.diff(word_at)), pa.array(spans, schema.types[3]), pa.array(items, schema.types[4])], schema=schema)

    return search


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, text, n_words, spans (merged word ranges [from, to) hit by test windows), items (ids of the items hit, sorted as strings)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), *(F.expr(f"cast(array() as {t})").alias(c) for c, t in HITS.items()),
    )
    parts = item_parts(benchmark, item_col, item_text_col)
    part, more = next(parts, []), next(parts, None)
    if more is None:
        return rows.mapInArrow(_search(spark.sparkContext.broadcast(Windows(part, width))), rows.schema)
    hits = part_hits(rows, chain([part, more], parts), width)
    both = with_hits(rows.drop("spans", "items"), hits, spans="spans", items="items")
    return both.mapInArrow(_search(spark.sparkContext.broadcast(Windows([], width))), rows.schema)  # counts words and merges spans


def part_hits(rows: DataFrame, parts: Iterator[list[tuple[str, str]]], width: int) -> DataFrame:
    """(KEY_NAMES, spans, items): one row for each distinct text with hits; one pass over ``rows`` for each part."""
    spark = rows.sparkSession
    tables = []
    for part in parts:
        windows = spark.sparkContext.broadcast(Windows(part, width))
        found = rows.mapInArrow(_search(windows), rows.schema).where(F.size("items") > 0)
        tables.append(saved(found.select(*(k.alias(n) for k, n in zip(text_keys(F.col("text")), KEY_NAMES, strict=True)), "spans", "items").dropDuplicates(list(KEY_NAMES)), "hits"))
        windows.destroy()
    # a text has at most one row in each table, so a group is as large as one text's hits
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
    return saved(reduce(DataFrame.union, tables).groupBy(*KEY_NAMES).agg(*lists), "hits")


def with_hits(rows: DataFrame, hits: DataFrame, **names: str) -> DataFrame:
    """``rows`` and columns of the hits of their texts, under new names; null without any. Hits grow with the input: they are not broadcast."""
    side = hits.hint("merge")
    same = reduce(Column.__and__, [k == side[n] for k, n in zip(text_keys(rows["text"]), KEY_NAMES, strict=True)])
    return rows.join(side, same, "left").select(*(rows[c] for c in rows.columns), *(side[c].alias(n) for c, n in names.items()))


def item_parts(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The distinct test items in parts of at most PART_WORDS words each (a longer item is a part); fetched partition by partition."""
    part: list[tuple[str, str]] = []
    held = 0
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    for item in items.toLocalIterator():
        n = len(item["text"]) // 2 + 1
        if held + n > PART_WORDS and part:
            yield part
            part, held = [], 0
        part.append((item["item"], item["text"]))
        held += n
    yield part


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with hit spans cut out of the text, from the first hit word to the last of each span."""
    spark = docs.sparkSession
    rows = docs if text_col == "text" else docs.withColumnRenamed(text_col, "text")
    parts = item_parts(benchmark)
    part, more = next(parts, []), next(parts, None)
    if more is None:
        cut = rows.mapInArrow(_cut(spark.sparkContext.broadcast(Windows(part, width))), rows.schema)
    else:
        plain = rows.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), *(F.expr(f"cast(array() as {t})").alias(c) for c, t in HITS.items()))
        hits = part_hits(plain, chain([part, more], parts), width)
        marked = with_hits(rows, hits, spans=SPANS)
        cut = marked.mapInArrow(_cut(None), rows.schema)
    return cut if text_col == "text" else cut.withColumnRenamed("text", text_col)


def _cut(windows):
    """Cuts the hits of ``windows`` out, or, without them, the word ranges in the last column, SPANS, which goes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            texts = b.column("text").to_pylist()
            given = None if windows else b.column(SPANS).to_pylist()
            for i, j in spans_of_bytes(offsets, SHARD_BYTES):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                lower = LOWER[part]
                starts, ends, word_at = word_spans(lower, off, LETTER_OR_DIGIT)
                ranges: dict[int, list] = {}
                if windows:
                    w: Windows = windows.value
                    found, which = shard_hits(lower, starts, ends, word_at, w)
                    for p, n in zip(found.tolist(), w.lengths[which].tolist(), strict=True):
                        ranges.setdefault(int(np.searchsorted(word_at, p, "right")) - 1, []).append((p, p + n))
                else:
                    for k in range(j - i):
                        if given[i + k]:
                            ranges[k] = [(x + int(word_at[k]), y + int(word_at[k])) for x, y in given[i + k]]
                for k, spans in ranges.items():
                    text, at, left = part[off[k] : off[k + 1]].tobytes(), 0, []
                    for s, e in merge(spans):
                        left.append(text[at : starts[s] - off[k]])
                        at = ends[e - 1] - off[k]
                    texts[i + k] = (b"".join(left) + text[at:]).decode()
            if not windows:
                b = b.drop_columns([SPANS])
            place = b.schema.get_field_index("text")
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return cut
