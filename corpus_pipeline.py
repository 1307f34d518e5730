"""A training-data pipeline over the table documents; every stage is written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
whose text is NULL or empty pass the stages by the rules that the operators state for them.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from auditframe.llm.base import crc_mod, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least 0.3 stay. It learns from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label"))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 3/4 connect the one with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of the token ids and of the text decoded from them."""
    raw = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # The executors' heaps have grown in the stages before, so the workers' tables stay at a twentieth.
    return bpe.digest_rows(docs, raw, share=0.05)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("byte-level BPE", tokens),
]

#: The learned stage and the tokenizer can't be written in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
