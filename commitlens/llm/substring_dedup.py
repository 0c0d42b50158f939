"""Removal of passages that an earlier document already holds, by hashes of every fixed-length token window.

1. Scan: every window of ``width`` consecutive words gets a Rabin-Karp hash from one prefix sum over the document's word hashes.
   A second, independent hash deals the windows to buckets, so the two together tell windows apart (64 bits and the bucket's).
   Equal windows of a few MB of text are combined before they are dealt on: those of larger doc_ids than the least are marked at once, and only those
   of the least go to the bucket. So a window that a third of all documents share is a few entries for each task. A task packs the
   windows of one bucket into one binary row: 8 bytes of hash and mostly one of place, as the gap to the document's window before.
2. Count: per bucket, the least doc_id of each hash is found; windows whose hash starts in a smaller doc_id are marked.
   No pair is ever formed.
3. Merge: the marked windows go to their documents' group, packed too, and become one row of maximal intervals a document. Those rows
   are joined to the texts by the document's key, and the intervals are cut out.

The number of buckets follows the bytes of all texts, so a bucket's share stays constant. Windows are compared by their hashes, not word by
word: among N windows about N * N / 2**65 / buckets are taken for another one's.

Defined results: null and short texts have no windows; a null doc_id counts as larger than all others; rows that repeat a doc_id
never count as earlier than one another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, buckets_for, mix, pack, range_hashes, saved, sha256_hex, spans_of_bytes, text_bytes, unpack, with_key, word_hashes, word_spans

LAST_ID = (1 << 63) - 1
#: Text whose windows make one bucket, about.
BUCKET_BYTES = 8 << 20
WINDOW_BASE, BUCKET_SALT = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)


def window_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of words[i:i+width] for each i of ``at``."""
    first = mix(range_hashes(words, at, at + width, WINDOW_BASE))
    with np.errstate(over="ignore"):
        second = mix(range_hashes(mix(words ^ BUCKET_SALT), at, at + width, WINDOW_BASE))
    return first, second


def window_starts(word_at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that start a window, and the text each lies in. word_at: each text's first word (len+1)."""
    counts = np.maximum(np.diff(word_at) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + word_at[:-1][text], text


def earlier_here(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows also start, among these, in a smaller doc_id."""
    order = np.argsort(first, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], first[order][1:] != first[order][:-1])))
    size = np.diff(np.append(edge, len(order)))
    marked = ids[order] > np.repeat(np.minimum.reduceat(ids[order], edge), size)
    marked &= np.repeat(np.minimum.reduceat(second[order], edge) == np.maximum.reduceat(second[order], edge), size)
    out = np.zeros(len(first), bool)
    out[order] = marked
    return out


def packed_places(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of windows by document and place: the documents, their numbers of windows, and the places as gaps."""
    used, at, count = np.unique(doc, return_index=True, return_counts=True)
    gaps = np.diff(place, prepend=0)
    gaps[at] = place[at]
    return used, count, pack(gaps)


def placed(count: np.ndarray, packed: bytes) -> np.ndarray:
    upto = np.cumsum(unpack(packed))
    return upto - np.repeat(np.concatenate(([0], upto))[np.cumsum(count) - count], count)


def read_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, text_keys, and (number in these, place) of each window of packed rows."""
    ids, keys, doc, at = [], [], [], []
    n = 0
    for doc_id, text_key, count, place in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text_key", "count", "place")), strict=True):
        count = np.frombuffer(count, "<u4")
        ids.append(np.frombuffer(doc_id, "<i8"))
        keys.append(np.frombuffer(text_key, "<i8"))
        doc.append(np.repeat(np.arange(n, n + len(count), dtype=np.int32), count))
        at.append(placed(count, place))
        n += len(count)
    return np.concatenate(ids), np.concatenate(keys), np.concatenate(doc), np.concatenate(at)


ROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.binary()), ("text_key", pa.binary()), ("count", pa.binary()), ("hash", pa.binary()), ("place", pa.binary())])
MARKED = pa.schema([("grp", pa.int32()), ("doc_id", pa.binary()), ("text_key", pa.binary()), ("count", pa.binary()), ("place", pa.binary())])


def groups_of(ids: np.ndarray, keys: np.ndarray, groups: int) -> np.ndarray:
    """Each document's group, by its id; documents without one, which can be many, are dealt by their text's key."""
    return (mix(np.where(ids == LAST_ID, keys, ids).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _scan(width: int, buckets: int):
    """Rows of open windows by bucket; marked ones go by group of documents, numbered after the buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            keys = b.column("text_key").to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(b.column("text"))
            for i, j in spans_of_bytes(offsets):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, word_at = word_spans(part, off, NOT_SPACE)
                at, text = window_starts(word_at, width)
                if not len(at):
                    continue
                first, second = window_hashes(word_hashes(part, starts, ends), at, width)
                here = earlier_here(first, second, ids[i:j][text])
                bucket = np.where(here, buckets + groups_of(ids[i:j], keys[i:j], buckets)[text], (second % np.uint64(buckets)).astype(np.int64))
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
                place = at - word_at[text]  # the window's first word within its document
                rows = []
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    mine = order[x:y]
                    used, count, packed = packed_places(text[mine], place[mine])
                    hashes = b"" if here[mine[0]] else first[mine].astype("<u8").tobytes()
                    rows.append({"bucket": int(bucket[mine[0]]), "doc_id": ids[i:j][used].astype("<i8").tobytes(), "text_key": keys[i:j][used].astype("<i8").tobytes(), "count": count.astype("<u4").tobytes(), "hash": hashes, "place": packed})
                yield pa.RecordBatch.from_pylist(rows, ROW)

    return scan


def _count(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        """Of one bucket: the windows that also start in a smaller doc_id, packed by group of documents."""
        if (bucket := table.column("bucket")[0].as_py()) >= buckets:  # marked by the scan
            grp = pa.array(np.full(len(table), bucket - buckets, np.int32))
            return pa.table([grp, *(table.column(c) for c in MARKED.names[1:])], schema=MARKED)
        ids, keys, doc, at = read_rows(table)
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("hash").to_pylist()])
        order = np.argsort(h)
        edge = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        least = np.minimum.reduceat(ids[doc[order]], edge)
        marked = order[ids[doc[order]] > np.repeat(least, np.diff(np.append(edge, len(order))))]
        if not len(marked):
            return MARKED.empty_table()
        doc, at, grp = doc[marked], at[marked], groups_of(ids, keys, buckets)
        order = np.lexsort((at, doc, grp[doc]))
        doc, at = doc[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(grp[doc]) != 0)))
        rows = []
        for mine, places in zip(np.split(doc, cuts[1:]), np.split(at, cuts[1:]), strict=True):
            used, n, packed = packed_places(mine, places)
            rows.append({"grp": int(grp[used[0]]), "doc_id": ids[used].tobytes(), "text_key": keys[used].tobytes(), "count": n.astype("<u4").tobytes(), "place": packed})
        return pa.Table.from_pylist(rows, MARKED)

    return count


def _merge(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("intervals", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        """Of one group of documents: each document's windows merged into maximal [from, to) intervals."""
        ids, keys, doc, at = read_rows(table)
        order = np.lexsort((at, keys[doc], ids[doc]))
        doc, at = doc[order], at[order]
        other = np.concatenate(([True], (np.diff(ids[doc]) != 0) | (np.diff(keys[doc]) != 0)))
        gap = other | np.concatenate(([True], at[1:] > at[:-1] + width))
        begin, end = at[gap], at[np.append(np.flatnonzero(gap)[1:], len(at)) - 1] + width
        of = np.cumsum(other)[gap] - 1
        cuts = np.searchsorted(of, np.arange(of[-1] + 2))
        both = np.stack((begin, end), 1).astype("<u4")
        blobs = [both[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([ids[doc[other]], keys[doc[other]], pa.array(blobs, pa.binary())], schema=schema)

    return merge


def removal_intervals(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, intervals): one row for each document with removals, its [from, to) word ranges as pairs of 32-bit numbers.

    ``docs`` as ``with_key`` gives it; doc_id is LAST_ID here where it is null.
    """
    n = buckets_for(docs, BUCKET_BYTES)
    windows = docs.mapInArrow(_scan(width, n), "bucket int, doc_id binary, text_key binary, count binary, hash binary, place binary")
    found = windows.groupBy("bucket").applyInArrow(_count(n), "grp int, doc_id binary, text_key binary, count binary, place binary")
    return found.groupBy("grp").applyInArrow(_merge(width), "doc_id long, text_key long, intervals binary")


def remove_repeats(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), kept_sha256, intervals (merged [from, to) word ranges)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.list_(pa.int64())))])
        for b in batches:
            ids, marks = b.column("doc_id"), b.column("intervals")
            raw, offsets = text_bytes(b.column("text"))
            for i, j in spans_of_bytes(offsets):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, word_at = word_spans(part, off, NOT_SPACE)
                rows = []
                for k in range(i, j):
                    s, e = starts[word_at[k - i] : word_at[k - i + 1]], ends[word_at[k - i] : word_at[k - i + 1]]
                    ranges = np.frombuffer(marks[k].as_py() or b"", "<u4").reshape(-1, 2).tolist()
                    gone = np.zeros(len(s), bool)
                    for x, y in ranges:
                        gone[x:y] = True
                    kept = b" ".join([part[x:y].tobytes() for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)])
                    rows.append((ids[k].as_py(), len(s), int(gone.sum()), kept.decode("utf-8", "replace"), sha256_hex(kept), ranges))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    docs = with_key(df, id_col, text_col)
    # the intervals grow with the input: they are never to be broadcast, however small they are now
    marks = saved(removal_intervals(docs, width), "intervals").withColumnRenamed("doc_id", "key_id")
    both = docs.join(marks.hint("merge"), (F.coalesce("doc_id", F.lit(LAST_ID)) == F.col("key_id")) & (docs["text_key"] == marks["text_key"]), "left")
    out = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, intervals array<array<long>>"
    return both.select("doc_id", "text", "intervals").mapInArrow(cut, out)
