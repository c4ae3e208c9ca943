"""Incremental ingest: a stream of documents fed into a store, a feed for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.analysis import ANALYSERS
from ..sources.store import Store


def ingest(docs: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feed a streaming DataFrame of (doc, title, text). A batch's number is its feed's id: one that
    is run again after a failure isn't counted twice."""

    def feed(batch: DataFrame, number: int) -> None:
        store.feed(ANALYSERS[store.analyser](batch), feed_id=f"batch-{number:012d}")

    writer = docs.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
