"""Re-indexing driven by a stream of file-change events.

Events (rel_path, content_hash, at) may come twice and late: a watermark bounds how long repeats are
remembered. Each micro-batch with news updates the graph once, whatever its number of events; the
update itself compares hashes, so it is safe to run again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index import Indexer


def distinct_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["rel_path", "content_hash"])


def follow(indexer: Indexer, events: DataFrame, checkpoint: str, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    def update(batch: DataFrame, _: int) -> None:
        if batch.count():  # reads every partition, as the state store wants
            indexer.update()

    return distinct_events(events, delay).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
