"""Exact length histogram: documents by encoded length, with suffix sums that answer for every context limit.

Each task counts its own documents by length, Spark adds the counts, and sums from the longest length down give, for each
length L: how many documents and tokens reach L, what remains if every document is cut to L tokens, and what is lost.
The histogram has at most one row per length, however many documents there are; the suffix sums run in blocks of lengths,
so no task gets all of them.

Defined results: a null text counts as empty (length 0); repeated rows each count; other columns and doc_id are ignored;
an empty table gives an empty histogram, for which every answer is 0 and every quantile null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, pa_schema, texts
from .tokens import ChunkTokenizer, default_path

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def length_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs: exact counts of whole documents by number of tokens."""
    path = path or default_path()
    schema = "length long, n_docs long"
    fields = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, counts = ChunkTokenizer(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts[len(tokenizer.ids([text.as_py()])[0]) // 4] += 1
        yield pa.RecordBatch.from_pydict({"length": list(counts), "n_docs": list(counts.values())}, schema=fields)

    return texts(docs).select("text").mapInArrow(run, schema).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length that occurs, exact answers for a context limit of that length.

    docs_from, tokens_from: of the documents of at least this length; docs_over: longer ones, which a limit would cut;
    kept_tokens: what is left if each document is cut to this length; lost_tokens: the rest; share_within: the part of
    documents that fit, so the q-quantile is the first length whose share_within is at least q.
    """
    df = counts.withColumn("__block", F.floor(F.col("length") / block)).withColumn("__tokens", F.col("length") * F.col("n_docs"))
    blocks = df.groupBy("__block").agg(F.sum("n_docs").alias("__n"), F.sum("__tokens").alias("__t"))
    # One row for every `block` lengths: a single task suffices up to billions of tokens in a document.
    above = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__n_above"),
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__t_above"),
        F.sum("__n").over(every).alias("__n_all"),
        F.sum("__t").over(every).alias("__t_all"),
    )
    within = Window.partitionBy("__block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(blocks, "__block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("__n_above")).alias("docs_from"),
        (F.sum("__tokens").over(within) + F.col("__t_above")).alias("tokens_from"),
        "__n_all",
        "__t_all",
    )
    kept = F.col("__t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    over = F.col("docs_from") - F.col("n_docs")
    return df.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        over.alias("docs_over"),
        kept.alias("kept_tokens"),
        (F.col("__t_all") - kept).alias("lost_tokens"),
        ((F.col("__n_all") - over) / F.col("__n_all")).alias("share_within"),
    )


def answer(sums: DataFrame, limit: int) -> dict[str, int]:
    """documents, tokens, docs_over and kept_tokens for any context limit, from the suffix sums: one small row."""
    longer = sums.filter(F.col("length") > limit)
    r = longer.agg(F.max("docs_from").alias("over"), F.max("tokens_from").alias("tokens")).first()
    least = sums.agg(F.max("docs_from").alias("docs"), F.max("tokens_from").alias("tokens")).first()
    docs, tokens, over = least["docs"] or 0, least["tokens"] or 0, r["over"] or 0
    return {"documents": docs, "tokens": tokens, "docs_over": over, "kept_tokens": tokens - (r["tokens"] or 0) + limit * over}


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least the part q of documents do not exceed."""
    return sums.filter(F.col("share_within") >= q).agg(F.min("length")).first()[0]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram with its suffix sums. Texts are encoded once: the histogram, a row a length, is a table."""
    return suffix_sums(checkpointed(length_counts(docs, path)))
