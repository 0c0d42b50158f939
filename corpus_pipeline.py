"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and extra columns pass as the operators define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import byte_bpe, decontaminate, jaccard_join, pii, toxicity
from commitlens.llm.common import saved, text_key
from commitlens.ship import ship


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (all columns of docs, with a new text) with n_chars set to the text's length."""
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    """The name, longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = _unused(docs, "score"), _unused(docs, "predicted")
    return toxicity.scores(docs, model, score, predicted).where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, directly or over others, the one with the smallest id stays.

    Rows without an id go if they are linked to one that has one; rows that repeat both id and text count once.
    """
    ship(spark)
    linked = jaccard_join.link(docs, words=5, num=80, den=100)
    gone = linked.where("component_id < doc_id or (doc_id is null and component_id is not null)")
    gone = saved(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "duplicates").hint("merge")
    # the row's own columns, of whatever names, travel as one
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), F.octet_length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    rest = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return rest.dropDuplicates(["id", "key", "size", "crc"]).select("row.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(docs, decontaminate.clean(docs, benchmark, 10))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return _with_text(docs, pii.sanitise(docs, pii.find(docs)))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, units=byte_bpe.UNITS, with_decoded=False).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", hide_personal_data),
    ("byte_bpe", tokenise),
]

#: The classifier, the tokenizer and the suffix order have no SQL form; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
