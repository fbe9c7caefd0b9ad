"""Cutting a plan's lineage in the folder that all executors share, and joins that no single key can fill a task of."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this part of the rows is split into as many pieces; so there are at most PIECES such keys.
PIECES = 256
#: Rows that no task minds.
FEW = 300
#: Rows of the smaller side that are broadcast, at most; more meet by a shuffle.
SENT = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master, as in tests, a folder of this machine if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "twinreport-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder as Parquet (with the writer's options) and read again, and the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def finished(df: DataFrame, paths: list[str]) -> DataFrame:
    """The rows as a checkpoint; the tables that `written` wrote to the paths, which they were read from, are deleted."""
    rows = checkpointed(df)
    for path in paths:
        removed(df.sparkSession, path)
    return rows


def met(rows: DataFrame, few: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """rows joined with few, which has n rows and is broadcast unless they are too many; how keeps rows' side or both."""
    return rows.join(F.broadcast(few), keys, how) if n <= SENT else rows.join(few, keys, how)


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, rows: int | None = None, pieces: int = PIECES, few: int = FEW
) -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key.

    The keys that hold more than one of `pieces` parts of left's rows, at most `pieces` of them, are split by a hash of
    the row, and their rows of right are there once for each piece. left is read more than once, so it should be a table;
    counts (keys and __m, left's rows of each key) and rows (how many left has), if known, save that.
    """
    if rows is not None and rows <= few:
        return left.join(right, keys, how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")) if counts is None else counts
    most, total = counts.agg(F.max("__m"), F.sum("__m")).first()
    share = max(few, (rows or total or 0) // pieces)
    if (most or 0) <= share:
        return left.join(right, keys, how)
    hot = counts.filter(F.col("__m") > share).select(*keys, F.ceil(F.col("__m") / F.lit(share)).cast("int").alias("__pieces"))
    hot = F.broadcast(checkpointed(hot))  # at most `pieces` rows
    salt = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.coalesce("__pieces", F.lit(1))))
    split = left.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__pieces")
    copies = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return split.join(copies, [*keys, "__salt"], how).drop("__salt")
