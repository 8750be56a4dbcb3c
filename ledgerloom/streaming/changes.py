"""Structured Streaming forms of the change operators.

``dirty_stream`` keeps the set of dirty units from a stream of change rows with
a batch function that is safe to repeat (a unit is written once per batch id);
``windowed_calls`` counts calls in event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import dirty_units


def dirty_stream(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        dirty_units(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_calls(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Calls of each firm in event-time windows, tumbling or, with ``slide``, overlapping; on a stream, rows later than ``late`` are dropped by the watermark. A stored table gives the same windows."""
    return calls.withWatermark("at", late).groupBy(F.window("at", window, slide), "firm_id").agg(F.count(F.lit(1)).alias("calls"))
