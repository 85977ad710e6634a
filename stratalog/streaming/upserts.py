"""Structured Streaming into a store, and a running latest view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def into_store(stream: DataFrame, store: Store, order: Callable[[], list], checkpoint: str, flush_every: int = 0) -> StreamingQuery:
    """Puts each micro-batch of ``(key, value)`` rows into the store; every ``flush_every`` batches are flushed."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.put(batch, order())
        if flush_every and number % flush_every == flush_every - 1:
            store.flush()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(stream: DataFrame) -> DataFrame:
    """The newest version of every key so far; state is one row a key."""
    return stream.groupBy("key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("v")).select("key", "v.seq", "v.value")
