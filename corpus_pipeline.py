"""A training corpus out of raw documents: five stages, each one operator of tideledger.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideledger.llm import decontam, linechunks, pieces, quality, simhash
from tideledger.llm.common import ship, table
from tideledger.llm.queries import tokenizer_file
from tideledger.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without chunks of lines that an earlier one has."""
    ship(spark)
    return linechunks.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles: that of the least doc_id."""
    ship(spark)
    return simhash.keep_one(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentations, beside its columns but the text."""
    ship(spark)
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL cannot express the stages' fingerprints and lattices; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
