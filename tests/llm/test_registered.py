"""The registered training-data queries against their SQL twins, or against plain versions where there is none."""

import os
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from commitlens.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows and rows == sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


def test_sharding(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_sharding"](spark, SF).collect()}
    sizes = [len((t or "").encode()) + 1 for _, t in documents]
    ends, slots = np.cumsum(sizes).tolist(), [0] * 16
    for (d, t), size, end in zip(documents, sizes, ends, strict=True):
        shard = min(15, (2 * (end - size) + size) * 16 // (2 * ends[-1]))
        r = got.pop(d)
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) == (size, zlib.crc32((t or "").encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
    assert not got


def test_pii(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, SF).collect()}
    for d, t in documents:
        base = brute.base_pii(t)
        r = got.pop(d)
        assert [r[f"n_{k}"] for k, _ in brute.PII] == [sum(rank == i for _, rank, _ in base) for i in range(4)]
        spans = [f"{brute.PII[rank][0]}:{start}:{end}" for start, rank, end in base]
        assert r["base_sha256"] == brute.sha(",".join(spans)) and set(spans) <= set(r["spans"].split(","))
    assert not got


def test_toxicity(spark, documents):
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in documents]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_byte_bpe(spark, documents):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    want = []
    for d, t in documents:
        ids = plain.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())))
    assert want == sorted(map(tuple, QUERIES["op8_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
