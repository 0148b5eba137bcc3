"""From raw documents to packed training windows: five stages, each on all that the one before has kept.

Each function takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, more columns than the usual ones included. An empty text is no good
document to the classifier (it scores low as far as the labels say so), no duplicate of another text but of empty ones,
and not contaminated; a null text counts as empty. A table without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridregimes.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from gridregimes.llm.common import Scratch, prepare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from labels of the documents it is given.

    A row is judged by its text alone, so repeated rows stay or go together; one with a null id teaches nothing.
    """
    prepare(spark)
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"), quality.remainder(F.col("doc_id"), 4) != 2)
    return quality.keep_good(docs, trees)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; a null id is the smallest, of rows repeated with one id one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles the one with the smallest id.

    A row with a null id or without words has no links and stays. Rows repeated with one id stay or go together.
    """
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark, by their text alone, whatever their id."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 token ids: one row per piece of a document, with the ids themselves.

    Each row is a document of its own, with a null or repeated id too; an empty one is its end id alone.
    """
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]
#: Trained trees and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
