"""Arrow batches in parts of bounded size, so that a worker's memory does not follow the rows or the lengths of texts in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of input that are worked on at once.
MOST = 1 << 20


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows where the session has Spark's default of 10,000, since texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def parts(batch: pa.RecordBatch, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about ``most`` bytes at a time, one row at least."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 4 * most:  # long rows lie together
            yield from parts(part, most)
        else:
            yield part


def of_lists(kind: pa.DataType, sizes: list[int], flat: pa.Array, gone: list[bool] | None = None) -> pa.Array:
    """A list array from the values of all rows one after the other; ``gone`` rows are null."""
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    mask = pa.array(gone, type=pa.bool_()) if gone and any(gone) else None
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat, type=pa.list_(kind), mask=mask)
