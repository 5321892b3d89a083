"""From raw documents to packed sequences: five corpus operators, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import linedup, mixing, nearcopies, packing, quality
from bidlake.llm.common import fresh, staged


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = fresh(docs, "held_out", "score", "predicted")[2]
    return quality.score(docs, model).where(F.col(predicted) == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; ``n_chars`` follows the text. A document that would be
    left without a word keeps its whole text, so that of many copies the next stage still finds one to keep."""
    (whole,) = fresh(docs, "whole")
    left = linedup.drop_frequent(docs.withColumn(whole, F.col("text")), 10)
    left = left.withColumn("text", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.col(whole))).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles of similarity 0.8 or more): the one with the smallest id,
    null ids last."""
    return nearcopies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    times = fresh(docs, "h", "size", "source_size", "target", "times")[4]
    return mixing.repeated(mixing.mix(docs), times).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("mixing", mix), ("best-fit packing", pack)]
#: Learned scores and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, "stage")
    return docs
