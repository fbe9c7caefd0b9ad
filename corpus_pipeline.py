"""The corpus pipeline: quality rules, one of each class of near copies, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined results: the first stage drops rows whose text is null or has fewer than 50 words; rows with a null doc_id stay as
long as the rules keep them, as they belong to no class; of repeated rows and ties one row of the least id stays; whole
texts go through every stage, whatever their length; a null source is a source of its own; columns besides those of
documents pass through the first four stages as they are; empty tables give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinreport.lineage import removed, written
from twinreport.llm import mixing, ngram_join, packing, pii, quality_rules
from twinreport.llm.common import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; equal rows share a verdict, a null or empty text is rejected."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, one row of the least id; rows with a null id stay."""
    return ngram_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, every row; n_chars follows the text, a null text stays null."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the proportions of their sources' weights; some are there twice, those without words not at all."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, of every row; a null text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", good),
    ("n-gram Jaccard join", distinct),
    ("personal data", private),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokenisation, the boosted trees and the hashes of the rules are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read is deleted, so
    only the last table, which the result reads, is left."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[-1]}")
        if before:
            removed(spark, before)
        before = path
    return docs
