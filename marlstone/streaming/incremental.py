"""Incremental steps as streams: results are appended batch by batch, and a restarted stream goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.dedup import first_by
from marlstone.sources.sinks import append_new


def append_batches(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True, buckets: int = 0) -> StreamingQuery:
    """Run ``step`` on each micro-batch and append rows of unseen keys, the first by ``order``, to the table at path.

    A batch that is replayed after a failure finds its keys there, so every key is written once.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_new(step(first_by(batch, key, order)), path, key, buckets)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(stream: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """The first row of each key, remembered for as long as ``late`` (a watermark bounds the state)."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
