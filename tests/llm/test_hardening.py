"""Personal data against a count of all pairs; the pipeline with clashing columns, nulls, repeats and empty tables."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from commitlens.llm import pii

SF = "/root/testdata/sf0.001"


def test_terms_of_entities_against_all_pairs(spark):
    rng = random.Random(12)
    people = [f"user{k}@mail.example" for k in range(12)] + ["10.0.0.1", "+49 30 1234567"]
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "xyz"] + ["überall", "ÜBERALL", "and"]
    docs = []
    for d in range(120):
        k = rng.randrange(len(people))
        own = [words[(k * 2 + j) % len(words)] for j in range(2)] if rng.random() < 0.8 else []
        parts = [people[k], *own, *rng.sample(words, rng.choice([0, 3]))] if rng.random() < 0.5 else rng.sample(words, 5)
        if d % 10 == 0:
            parts += ["list@of.example", "dir@of.example", "directory", "listing", "abcdlist@of.example"]
        rng.shuffle(parts)
        docs.append((d, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect()}
    want = brute.telling_terms(docs)
    assert got == want and sum(rank > 3 for s in want.values() for _, rank, _ in s) > 20


def test_terms_over_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert got == brute.telling_terms([tuple(r) for r in docs.collect()])


def test_long_directories_take_linear_time(spark):
    def took(k):
        text = " ".join(f"user{i}@mail.example word{''.join(chr(97 + int(c)) for c in str(i))}x" for i in range(k))
        df = spark.createDataFrame([(i, f"{text} doc{i}") for i in range(4)] + [(100 + i, "plain text about nothing") for i in range(40)], "doc_id long, text string")
        began = time.time()
        assert pii.find(df).select(F.sum(F.size("spans"))).first()[0] == 8 * k
        return time.time() - began

    took(100)
    assert took(4000) < 4 * took(1000) + 10


CLASHES = "_id _key _score _predicted score predicted _text_key _size _crc text_key size crc component_id spans id key row gone_id words marks".split()


@pytest.fixture(scope="module")
def odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(2)).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(9_999).cast("long")))
    return docs.union(more).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_columns(spark, odd_rows, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_rows, SF)
    if name == "byte_bpe":
        assert out.count() == odd_rows.count()
        return
    assert out.columns == odd_rows.columns
    rows = out.collect()
    assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c} of {r['doc_id']}") for r in rows for c in CLASHES)


def test_run_from_end_to_end(spark, odd_rows, tmp_path):
    odd_rows.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    plain = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()}
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect()}
    assert len({d for d, *_ in plain} & {d for d, *_ in got}) > 0.9 * len(plain)
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_tables_stay_in_the_catalog(spark):
    from commitlens.llm.queries import QUERIES

    assert QUERIES["op8_byte_bpe"](spark, SF).where("n_tokens > 0").count() > 0
    assert spark.catalog.listTables() == []
