"""Structured Streaming into a store, and a stream's rows into a queue."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandgrid.sources.queues import Queues
from strandgrid.sources.store import RETRIES, Conflict, StoredTable


def save_stream(stream: DataFrame, table: StoredTable, checkpoint: str, name: str, **trigger: Any) -> StreamingQuery:
    """Save every micro-batch as one commit.  The commit notes the batch's number, so a batch that is run again after a
    failure changes nothing: each row is saved exactly once."""

    def save(batch: DataFrame, number: int) -> None:
        for attempt in range(RETRIES):
            tx = table.store.transaction()
            if tx.state["streams"].get(name, -1) >= number:
                tx.rollback()
                return
            try:
                tx.save_batch(table, batch)
            except BaseException:
                tx.rollback()
                raise
            try:
                tx.commit(stream=(name, number))
                return
            except Conflict:
                if attempt == RETRIES - 1:
                    raise

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def queue_stream(stream: DataFrame, queues: Queues, kind: str, checkpoint: str) -> StreamingQuery:
    """Put a small stream's rows into a queue of the driver; a full queue fails the batch, which is tried again on restart."""

    def put(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            queues.put(kind, row.asDict())

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
