"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, list]]]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists: make() is called once a task and returns the function for a batch."""
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                for out in each(batch.to_pydict()):
                    yield pa.RecordBatch.from_pydict(out, schema=fields)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
