"""The corpus pipeline: documents without toxic ones, without exact and near copies, mixed to target weights, as tokens.

``STAGES`` are (name, function) pairs. Each function takes the session, the rows that the stage before it kept, and the
folder of the tables; all but the last give the columns of ``documents``. ``run`` applies them in order. The stages learn
from and count over what reaches them: the mix weighs the sources as they are after deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.bpe import bpe_round_trip
from gleanery.llm.common import checkpointed
from gleanery.llm.exact_dedup import exact_dedup
from gleanery.llm.mixing import mixed
from gleanery.llm.ngram_join import without_near_duplicates
from gleanery.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the smallest doc_id."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what encoding and decoding each document gives."""
    return bpe_round_trip(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixing), ("BPE", tokens)]

#: SQL cannot express the classifier, the draws and the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage keeps is written once, to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
