"""Arrow batches in Python workers, cut so that a worker's memory doesn't grow with the size of texts or partitions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once, but for a single text that is longer.
SLICE_BYTES = 1_000_000

#: Rows of an Arrow batch where rows hold whole texts.
BATCH_ROWS = 512


def whole_texts(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Arrow batches of at most BATCH_ROWS rows.

    The setting is read when a result is computed, which may be after the operator has returned, so it stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def slices(batch: pa.RecordBatch, column: int, rows: int = 2048, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and so many bytes in a string or binary column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Return freed memory to the system: reused workers would hold on to the most they ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass
