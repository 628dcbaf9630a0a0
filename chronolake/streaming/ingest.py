"""Points from a stream, appended to a table batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Table


def append_stream(points: DataFrame, table: Table, checkpoint: str, order: Column | None = None, **trigger) -> StreamingQuery:
    """Write a stream of points (timestamp, metric, tag_<key>, value) to ``table``.

    A point that comes late is an ordinary upsert, so there is no watermark. The
    table notes the last batch of each checkpoint, so that a batch that is
    repeated after a failure isn't written twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.put_points(batch, order, (checkpoint, number))

    return points.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
