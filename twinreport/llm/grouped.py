"""Python over whole groups of rows, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pa_schema

#: Rows and bytes that a task gathers before it works on them; a larger group is held whole.
ROWS, BYTES = 100_000, 32 << 20


def chunks(batches: Iterator[pa.RecordBatch], key: str, rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by key."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        # While one key goes on, nothing is put together.
        if (n >= rows or size >= BYTES) and held[0].column(key)[0].as_py() != batch.column(key)[-1].as_py():
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield table.slice(0, cut)
            # A copy, so that what is done is let go.
            held = pa.Table.from_batches(table.slice(cut).to_batches()).take(np.arange(table.num_rows - cut)).to_batches()
            n, size = table.num_rows - cut, sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped(df: DataFrame, key: str, each: Callable[[pa.Table], Iterator[dict]], schema: str, order: list[str] | None = None) -> DataFrame:
    """Runs `each` over tables of whole groups of the key, sorted by it and the columns `order`."""
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, key):
            for out in each(table):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in fields], schema=fields)

    return df.repartition(key).sortWithinPartitions(key, *(order or [])).mapInArrow(run, schema)
