"""Byte-level BPE by a global shuffle of distinct words.

1. Explode: a task splits the whole texts of a few MB of documents (a block) into pre-tokens, once. The block keeps its documents as the
   sequence of each position's place in the block's word list, most frequent words first, one to four bytes a position, and each distinct
   word of the block with its place. Blocks are written to the shared folder under a new random name, as a table bucketed by it, so whatever
   reads them later sees the same blocks, also when the rows come in another order or a lost task runs again.
2. Encode: words are shuffled by their hash, so equal words of all blocks meet and each distinct word of the corpus is encoded once.
3. Join back: the ids return to their blocks with the places; a block's documents are reassembled by position.
4. Decode: ids are joined to the token-byte table, which is broadcast: it has one entry a rank, so its size is fixed by the vocabulary.

Words and ids travel packed, one row per block and bucket of words. A word that occurs everywhere adds one entry per block, never one per
occurrence. A block holds about BLOCK_BYTES of text, or one longer text. The number of buckets follows the bytes of all texts.

Defined results: null and empty texts have no tokens; a repeated row is encoded again; an empty table gives no rows; texts of
any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_for, pack, plain_string_array, spans_of_bytes, text_bytes, unpack

#: Text of one block, and the text whose distinct words make one bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def parsed(table: bytes) -> dict[bytes, int]:
    """Ranks of tokens, from lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in table.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def word_encoder(table: bytes) -> tiktoken.Encoding:
    """Encodes its whole input as one pre-token; kept for a worker's later groups."""
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=parsed(table), special_tokens={})


class Numbers(dict):
    """Numbers what is looked up, in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: White space as Unicode's property has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units of the public pattern: a run without white space with the one space before it, or white space as the pattern takes it.
#: No pre-token crosses their borders, so a text's pre-tokens are those of its units, and each distinct unit is split once a block.
UNITS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _read_blocks(batches: Iterator[pa.RecordBatch], pattern: str, units: str | None) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[str]]]:
    """Blocks as (doc_ids, pre-tokens of each document, place of each position, words by place)."""
    split = regex.compile(pattern).findall
    find = re.compile(units).findall if units else split

    def block(parts: list[tuple[list, list[str]]]):
        unit, word = Numbers(), Numbers()
        numbers, ids = [], []
        for doc_ids, texts in parts:
            for text in texts:
                found = find(text)
                numbers.append(np.fromiter(map(unit.__getitem__, found), np.int32, len(found)))
            ids += doc_ids
        words_of = [split(u) for u in unit] if units else [(u,) for u in unit]
        unit_words = np.fromiter((word[w] for words in words_of for w in words), np.int32)
        size = np.fromiter(map(len, words_of), np.int64, len(words_of))
        unit_at = np.concatenate(([0], np.cumsum(size)))
        flat = np.concatenate(numbers)
        ends = np.concatenate(([0], np.cumsum(size[flat])))[np.cumsum([len(n) for n in numbers])]
        # positions a part at a time, as their numbers are wider than what is kept
        flat = np.concatenate([np.zeros(0, np.int32), *(unit_words[gather(unit_at, flat[k : k + (1 << 19)])] for k in range(0, len(flat), 1 << 19))])
        often = np.argsort(-np.bincount(flat, minlength=len(word)), kind="stable")
        place = np.empty(len(word), np.int32)
        place[often] = np.arange(len(word))
        names = list(word)
        return ids, np.diff(ends, prepend=0).astype("<u4"), place[flat], [names[k] for k in often.tolist()]

    held, size = [], 0
    for b in batches:
        texts = plain_string_array(b.column("text"))
        _, offsets = text_bytes(texts)
        for i, j in spans_of_bytes(offsets, BLOCK_BYTES // 4):
            held.append((b.column("doc_id").slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist()))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


WORDS = "array<struct<bucket:int,places:binary,lengths:binary,words:binary>>"


def _blocks(pattern: str, units: str | None, buckets: int):
    one = pa.struct([("bucket", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.binary()), ("positions", pa.binary()), ("words", pa.list_(one))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for ids, counts, places, words in _read_blocks(batches, pattern, units):
            raw = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(raw) else np.zeros(0, np.int64)
            parts = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mine = order[x:y]
                some = [raw[i] for i in mine.tolist()]
                parts.append({"bucket": int(bucket[mine[0]]), "places": pack(np.diff(mine, prepend=0)), "lengths": pack(np.array([len(w) for w in some])), "words": squeeze(b"".join(some))})
            packed = b"".join(pack(places[k : k + (1 << 19)]) for k in range(0, len(places), 1 << 19))
            yield pa.RecordBatch.from_pylist([{"block": uuid.uuid4().int >> 65, "doc_ids": ids, "n_words": counts.tobytes(), "positions": squeeze(packed), "words": parts}], schema)

    return blocks


def _encode(table):
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def encode(rows: pa.Table) -> pa.Table:
        """Of one bucket of words: each distinct word's ids, once; then the ids of each block's words."""
        one = word_encoder(table.value).encode_ordinary
        expand = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, list[int]] = {}
        out_rows = []
        for block, places, lengths, words in zip(*(rows.column(c).to_pylist() for c in ("block", "places", "lengths", "words")), strict=True):
            words = expand(words)
            at, counts, out = 0, [], []
            for n in unpack(lengths).tolist():
                w = words[at : at + n]
                at += n
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = one(w.decode())
                counts.append(len(ids))
                out += ids
            out_rows.append({"block": block, "places": places, "counts": pack(np.array(counts)), "ids": pack(np.array(out))})
        return pa.Table.from_pylist(out_rows, schema)

    return encode


def gather(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Numbers of all elements of the runs [offsets[w], offsets[w+1]) for each w of ``which``, one after the other."""
    n = offsets[which + 1] - offsets[which]
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(offsets[which] - (end - n), n)


@lru_cache(maxsize=2)
def token_bytes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, end to end by rank, and each rank's offset in them (len+1); ranks may have gaps."""
    by_rank = sorted((rank, token) for token, rank in parsed(table).items())
    size = np.zeros(by_rank[-1][0] + 2, np.int64)
    for rank, token in by_rank:
        size[rank + 1] = len(token)
    return np.frombuffer(b"".join(token for _, token in by_rank), np.uint8), np.cumsum(size)


def _assemble(table, with_ids: bool, with_decoded: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_bytes, table_at = token_bytes(table.value)
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, n_words, positions, parts = (b.column(c)[row].as_py() for c in ("doc_ids", "n_words", "positions", "parts"))
                none = np.zeros(0, np.int64)
                place = np.concatenate([none, *(np.cumsum(unpack(p["places"])) for p in parts or [])])
                count = np.concatenate([none, *(unpack(p["counts"]) for p in parts or [])])
                ids = np.concatenate([none, *(unpack(p["ids"]) for p in parts or [])])
                begin = np.cumsum(count) - count
                order = np.argsort(place)
                ids = ids[gather(np.append(begin, len(ids)), order)] if len(order) else ids  # by place
                at = np.concatenate(([0], np.cumsum(count[order])))
                words = unpack(expand(positions))
                counts = np.frombuffer(n_words, "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                out, held = [], 0
                for doc_id, s, e in zip(doc_ids, (ends - counts).tolist(), ends.tolist(), strict=True):
                    mine = ids[gather(at, words[s:e])]
                    decoded = table_bytes[gather(table_at, mine.astype(np.int64))].tobytes()
                    out.append((doc_id, len(mine), hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), mine.astype(np.int32) if with_ids else None, decoded if with_decoded else None))
                    held += 200 + len(decoded) * (2 * with_ids + with_decoded)
                    if held > 8 << 20:
                        yield _batch(out, schema)
                        out, held = [], 0
                if out:
                    yield _batch(out, schema)

    return assemble


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", units: str | None = None, with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded (the bytes that the ids stand for).

    ``ranks_path`` is read on the driver and broadcast; ``pattern`` splits texts into pre-tokens; ``units``, if given, is a
    coarser pattern whose matches cover a text and hold its pre-tokens whole (UNITS for the public pattern).
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = buckets_for(docs, BUCKET_BYTES)
    blocks = docs.mapInArrow(_blocks(pattern, units, n), f"block long, doc_ids array<long>, n_words binary, positions binary, words {WORDS}")
    blocks = bucketed(blocks, "block", "blocks")  # so that the positions are not shuffled to meet the ids
    words = blocks.select("block", F.explode("words").alias("w")).select("w.bucket", "block", "w.places", "w.lengths", "w.words")
    encoded = words.groupBy("bucket").applyInArrow(_encode(table), "block long, places binary, counts binary, ids binary")
    lists = encoded.groupBy("block").agg(F.collect_list(F.struct("places", "counts", "ids")).alias("parts"))  # one entry a bucket
    whole = blocks.select("block", "doc_ids", "n_words", "positions").join(lists, "block", "left")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary"
    return whole.select("doc_ids", "n_words", "positions", "parts").mapInArrow(_assemble(table, with_ids, with_decoded), out)
