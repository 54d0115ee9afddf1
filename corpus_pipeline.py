"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's docs. All but
the last keep the columns of documents, whatever further columns there are and however they are named. Null and empty
texts pass as empty ones, repeated rows are judged alike, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import copies, decontamination, packing, pii, quality
from tidewire.llm.common import KEY, text_key
from tidewire.session import scratch_path
from tidewire.sources.mart import read_mart


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at its threshold or above."""
    machine = quality.fitted(docs, read_mart(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select(F.struct("*").alias("row"), "text"), machine, ["row"])
    return rows.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: five-word shingles, Jaccard 0.8 or more."""
    return copies.representatives(docs)


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    _, hits = decontamination.window_hits(docs, read_mart(spark, sf_dir, "benchmark"))
    rows = docs.select(F.struct("*").alias("row"), *text_key())
    return rows.join(hits.select(*KEY).distinct(), list(KEY), "left_anti").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each personal span replaced by its kind."""
    return pii.masked_documents(docs, pii.train(pii.sample_passages(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their token ids: pieces of binary length; ``draw`` orders a bucket at random."""
    return packing.pieces(docs).select(
        "doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        F.col("length").alias("bucket"), F.xxhash64("doc_id", "start").alias("draw"))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_clean_of_benchmarks),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: A trained classifier and a byte-pair tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_mart(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
