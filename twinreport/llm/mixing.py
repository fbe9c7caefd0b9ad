"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every document waits in its source's queue, in an order shuffled by a hash of its id and text, and a queue is served again from
its start when it has been served whole, up to `passes` times. A document's virtual finish time is the words its source has
been served with it, divided by the source's weight; serving in order of finish time gives the sources their weights. A
source whose queue ends early leaves its share to the others, as in fair queueing. The stream is range-sorted by finish
time and truncated where the words served reach the budget. The finish time at which that is so, the level, follows from
the sources' totals alone, so no running sum over the stream is needed: what finishes by the level is in the mix. The
document that a source is being served at the level is taken in part (`mix`), or whole if at least half (`mixed_documents`).

The sums along a queue are taken in two steps, within buckets of the shuffled order and over the buckets' totals, so a
source with a third of all rows is spread over many tasks.

Defined results: a null text counts as empty (size 0, nothing taken); a null source is a source of its own, the last one;
rows with a null doc_id or equal doc_ids are shuffled by their texts, and rows equal in both are
interchangeable; other columns are ignored by `mix` and returned by `mixed_documents`; an empty table gives no rows;
sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the corpus.
SHARE = 1.5
#: A document may be served so often.
PASSES = 2
#: Hex digits of the shuffle hash that name a bucket: 4096 buckets a source.
DIGITS = 3
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, weight, target, level (the same in all rows): one row a source.

    A source's target is the lesser of `passes` times its size and level * weight, with the level at which the targets
    fill the budget: sources by ratio of limit to weight, those below the level are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = by_source.withColumn("weight", weight).withColumn("__limit", passes * F.col("source_size"))
    df = df.withColumn("__ratio", F.col("__limit") / F.col("weight"))
    # One row a source; the windows hold the list of sources, not their documents.
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    df = df.withColumn("__level", level)
    first = F.when(F.col("__level") <= F.col("__ratio"), F.struct(F.row_number().over(by_ratio).alias("n"), "__level"))
    df = df.withColumn("__first", first)
    found = F.min("__first").over(every)["__level"]
    df = df.withColumn("level", F.coalesce(found, F.lit(float("inf"))))
    target = F.least(F.col("__limit").cast("double"), F.coalesce(F.nanvl(F.col("level") * F.col("weight"), F.lit(0.0)), F.lit(0.0)))
    return df.select("source", "source_size", "weight", target.alias("target"), "level")


def _served(docs: DataFrame, weights: tuple[float, ...], share: float, passes: int, digits: int, seed: str, keep: bool) -> DataFrame:
    """size, its source's numbers, __upto: words of the source up to and with the row in one pass; __document if keep."""
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    columns = ["doc_id", "source", words(F.col("text")).alias("size"), key.alias("__source"), shuffle.alias("__hash")]
    slim = docs.select(*columns)
    if not keep:
        slim = checkpointed(slim)  # texts are read and counted once
    rows = docs.select(*columns, F.struct(*docs.columns).alias("__document")) if keep else slim
    bucket = F.substring("__hash", 1, digits)
    sources = targets(slim, weights, share, passes).withColumn("__source", key)
    sums = slim.groupBy("__source", bucket.alias("__bucket")).agg(F.sum("size").alias("__size"))
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__source", "__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"))
    sums = sums.join(sources.drop("source"), "__source")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("__bucket", bucket).withColumn("__inside", F.sum("size").over(inside)).join(sums, ["__source", "__bucket"])
    return df.withColumn("__upto", F.col("__inside") + F.col("__ahead"))


def _finish(p: int) -> Column:
    """Virtual finish time of the row in pass p."""
    return (F.col("__upto") + p * F.col("source_size")) / F.col("weight")


def _taken(p: int) -> Column:
    """Words of the row that pass p serves by the level: all if it finishes by then, else what its source still has."""
    start = F.col("__upto") - F.col("size") + p * F.col("source_size")
    part = F.greatest(F.floor(F.col("level") * F.col("weight")).cast("long") - start, F.lit(0))
    return F.when(_finish(p) <= F.col("level"), F.col("size")).otherwise(F.least(part, F.col("size")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, digits: int = DIGITS, seed: str = SEED) -> DataFrame:
    """One row per row of docs, in order of finish time: doc_id, source, size, source_size, target, first_finish, taken.

    taken: words of the document before the cut, over all passes; first_finish: virtual finish time in the first pass, to
    which pass p adds p * source_size / weight.
    """
    df = _served(docs, weights, share, passes, digits, seed, keep=False)
    taken = sum((_taken(p) for p in range(passes)), F.lit(0).cast("long"))
    df = df.select("doc_id", "source", "size", "source_size", "target", _finish(0).alias("first_finish"), taken.alias("taken"))
    return df.orderBy("first_finish", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, digits: int = DIGITS, seed: str = SEED) -> DataFrame:
    """The mix as whole documents, all columns of docs, in order of finish time; a document served twice is there twice."""
    df = _served(docs, weights, share, passes, digits, seed, keep=True)
    served = F.filter(F.array(*(F.when((F.col("size") > 0) & (2 * _taken(p) >= F.col("size")), _finish(p)) for p in range(passes))), lambda x: x.isNotNull())
    return df.select("__document", F.explode(served).alias("__finish")).orderBy("__finish").select("__document.*")
