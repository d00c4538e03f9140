"""Streams into an index: each micro-batch is inserted as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index import VectorIndex


def ingest(vectors: DataFrame, index: VectorIndex, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """vectors: a stream of (vec_id, embedding). A batch that is delivered again replaces its rows."""

    def put(batch: DataFrame, number: int) -> None:
        index.upsert(batch)

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
