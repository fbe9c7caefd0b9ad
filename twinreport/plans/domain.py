"""The driver's tables as reports: documents are the corpus, benchmark the incoming reports, exact copies the duplicates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..lineage import checkpointed, finished, met, removed, written
from ..functions import text as T
from ..operators import similarity, terms
from ..operators.pruned import Pruned

#: For tables of terms, which repeat far apart.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
BIDF = Settings()
TFIDF = Settings(tfidf_algorithm="tfidf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _report(df: DataFrame, key: str, name: str, *more) -> DataFrame:
    """The first line is the summary, the whole text the description, both in lower case."""
    return df.select(F.col(key).alias(name), *more, F.lower(F.substring_index("text", "\n", 1)).alias("summ"), F.lower("text").alias("desc"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(table(spark, sf_dir, "documents"), "doc_id", "bug_id", F.col("source").alias("product"), (F.col("doc_id") * 86400).alias("ts"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(table(spark, sf_dir, "benchmark"), "item_id", "query_id")


def incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("bug_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each exact copy and the first document of its text. Texts meet by their 256-bit digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return docs.join(first, "h").filter("doc_id != dst").select(F.col("doc_id").alias("src"), "dst")


class Counted(NamedTuple):
    """Term counts of the incoming reports and of the corpus, document counts by field, all tables; number of reports."""

    ours: DataFrame
    counts: DataFrame
    dfs: DataFrame
    n: int
    paths: list[str]  # of the tables; who returns rows that no longer need them may delete them (`finished`)


def counted(spark: SparkSession, sf_dir: str, settings: Settings, asked: DataFrame | None = None) -> Counted:
    """What follows from the texts, each tokenised once. asked: the incoming reports, if they are others than the table's.

    The corpus' counts lie report by report, in columns: without shuffling them, and in less than the texts' size.
    """
    docs = corpus(spark, sf_dir)
    counts, at = written(terms.local_counts(docs, settings), "counts", **PACKED)
    dfs, dfs_at = written(terms.field_counts(counts), "dfs", **PACKED)
    asked = incoming(spark, sf_dir) if asked is None else asked
    ours = checkpointed(terms.term_counts(asked, settings, "query_id", synonyms=False))
    return Counted(ours, counts, dfs, docs.count(), [at, dfs_at])


def weighted(spark: SparkSession, sf_dir: str, settings: Settings, made: tuple | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Vectors of the incoming reports and of the corpus, document counts by field, number of reports.

    Texts are tokenised once: the term counts are a table, from which all else follows. made: what `counted` returned.
    """
    ours, counts, dfs, n, _ = made or counted(spark, sf_dir, settings)
    return terms.weights(ours, dfs, n, settings.tfidf_algorithm, "query_id"), terms.weights(counts, dfs, n, settings.tfidf_algorithm), dfs, n


def asked_of(made: Counted, settings: Settings) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """Vectors of the incoming reports, how many rows they have, those of the corpus for the terms of incoming reports
    alone, as no other adds to a product, and the document counts of these terms."""
    ours, counts, dfs, n, _ = made
    asked = ours.select("field", "term").distinct()
    n_terms = ours.count()
    dfs_ = checkpointed(met(dfs, asked, ["field", "term"], n_terms))
    q = checkpointed(terms.weights(ours, dfs_, n, settings.tfidf_algorithm, "query_id"))
    if settings.tfidf_algorithm == "tfidf":
        return q, n_terms, terms.scaled(counts, terms.lengths(counts, dfs, n), dfs_, n, n_terms), dfs_
    c = met(counts, dfs_, ["field", "term"], n_terms).select("bug_id", "field", "term", terms.idf(F.lit(n), F.col("df")).alias("w"))
    return q, n_terms, c.repartition("bug_id"), dfs_


def searched(spark: SparkSession, sf_dir: str, settings: Settings = BIDF, made: tuple | None = None, without: DataFrame | None = None) -> Pruned:
    """The corpus ready for searches by the incoming reports. made: what `counted` returned, tables that stay; without: no
    candidates. The tables that are deleted at the end are the search's `paths`."""
    own = made or counted(spark, sf_dir, settings)
    ours, _, theirs, dfs = asked_of(own, settings)
    if settings.tfidf_algorithm == "bidf":  # a term weighs the same everywhere, so the corpus needs no weights of its own
        one = F.lit(0).alias("block")
        theirs, path = written(theirs.select("bug_id", one, "field", "term"), "theirs", **PACKED)
        weights = dfs.select("field", "term", one, terms.idf(F.lit(own.n), F.col("df")).alias("top"), "df")
    else:  # a term of a short report weighs more
        sizes = own.counts.groupBy("bug_id").agg(F.floor(2 * F.log2(F.sum("tf"))).cast("int").alias("block"))
        theirs, path = written(theirs.filter("w != 0").join(sizes, "bug_id"), "theirs", **PACKED)
        weights = theirs.groupBy("field", "term", "block").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("df"))
    search = Pruned(ours, theirs, weights, settings, without)
    search.paths.append(path)
    for path in [] if made else own.paths:  # what is searched is a table of its own
        removed(spark, path)
    return search


def ask(spark: SparkSession, sf_dir: str, summary: str, description: str, n: int = 10, settings: Settings = BIDF) -> DataFrame:
    """bug_id, score, rank of the n reports most like a summary and a description."""
    asked = spark.createDataFrame([(0, summary.lower(), description.lower())], "query_id long, summ string, desc string")
    made = counted(spark, sf_dir, settings, asked)
    search = searched(spark, sf_dir, settings, made)
    rows = search.top(n).drop("query_id")
    return finished(rows, [*search.paths, *made.paths])


def compared(spark: SparkSession, sf_dir: str, settings: Settings = BIDF, made: Counted | None = None) -> DataFrame:
    """query_id, bug_id, rs, rd for pairs that share a term; made: what `counted` returned, if it is at hand.

    The terms that both sides hold are dealt by report, and summed where they then lie; pairs are not shuffled.
    """
    q, n_terms, c, _ = asked_of(made or counted(spark, sf_dir, settings), settings)
    return similarity.similarities(q, c, settings, n_terms=n_terms)


def pairs(spark: SparkSession, sf_dir: str, settings: Settings = BIDF, made: Counted | None = None) -> DataFrame:
    """query_id, bug_id, score by the weighted strategy, for one step that reads them."""
    nl = F.col("rs") * settings.bug_summary_ratio + F.col("rd") * settings.bug_description_ratio
    return compared(spark, sf_dir, settings, made).select("query_id", "bug_id", F.round(nl, similarity.DIGITS).alias("score"))


def scored(spark: SparkSession, sf_dir: str, settings: Settings = BIDF, made: Counted | None = None) -> DataFrame:
    """The same as a table that several steps read."""
    return checkpointed(pairs(spark, sf_dir, settings, made))


def best_of(spark: SparkSession, sf_dir: str, n: int, settings: Settings = BIDF, made: Counted | None = None) -> DataFrame:
    """query_id, bug_id, score, rank: the n best of all pairs, as a checkpoint; tables that were made for it are deleted."""
    own = made or counted(spark, sf_dir, settings)
    return finished(similarity.top(pairs(spark, sf_dir, settings, own), n), [] if made else own.paths)


def trace(key: str, every: int):
    """Made-up traces, as the texts hold none: one thread of the first tokens, for one report in `every`."""
    words = T.tokens(F.col("desc"))
    return F.when(F.col(key) % every == 0, F.array(F.slice(words, 1, 8))).otherwise(F.array().cast("array<array<string>>"))
