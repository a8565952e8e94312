"""Writes as a stream. Valid time is not arrival time: nothing is late, so there is no watermark."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import increment
from ..sources.store import Store


def start(writes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Maintain ``store`` from a streaming DataFrame of writes. A replayed batch is a no-op: batches are known by
    the query's id, which lives in its checkpoint, and their number, so two streams, or one that is
    begun again on a fresh checkpoint, are never taken for each other."""
    known, named = [], threading.Event()

    def upsert(batch: DataFrame, number: int) -> None:
        named.wait(60)
        batch = batch.persist()
        try:
            store.apply(lambda current: increment(current, batch), batch=(known[0], number), entities=batch.select("kind", "entity_id"))
        finally:
            batch.unpersist()

    query = writes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    known.append(query.id)
    named.set()
    return query
