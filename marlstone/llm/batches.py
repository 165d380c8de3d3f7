"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 2000
BYTES = 16 << 20
#: Spark's own bounds (10,000 rows, 64 MB) let buffers beside the heap grow by some 100 MB a task.
BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES)}


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's batches where it has no bounds of its own; what a caller has set stays as it is.

    Spark reads the bounds when a plan runs, which is after a lazy result was handed out, so they cannot be reset here.
    """
    for key, value in BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of rows, which bounds the Python objects made from them."""
    for b in batches:
        for a in range(0, max(len(b), 1), rows):
            yield b.slice(a, rows)
