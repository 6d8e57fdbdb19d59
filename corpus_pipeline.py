"""A corpus pipeline of five stages: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns
of documents. Stages with no rows to work on return none. Rows are kept whole; only texts with personal data change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, ngram_join, pii, toxicity
from tidemark.llm.common import checkpoint_dir, few, table
from tidemark.operators import files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    docs = few(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies, the document with the smallest id, once; texts without words stay."""
    docs = few(docs)
    return few(ngram_join.one_of_each(docs), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    docs = few(docs)
    masked = few(pii.mask_personal(docs), docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated chances."""
    return mixing.mix(few(docs), mixing.TARGETS, mixing.FRACTION).where("selected").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and whether decoding gives the text back."""
    both = bpe.bpe_round_trip(few(docs), bpe.default_vocabulary())
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", mask_personal_data),
    ("mixing to target weights", mix_to_targets),
    ("BPE encoding and decoding", tokens),
]

#: No SQL: classifiers, MinHash groups and tokenisation are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; what the next stage has read goes."""
    docs = table(spark, sf_dir, "documents")
    shared = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
        files.delete(spark, f"{shared}/{k - 1}")
    return docs
