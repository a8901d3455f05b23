"""Structured Streaming over the same data: deltas as they arrive, and windows over events.

The data model has no event-time streams of its own; the windows here are an addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "1 day"


def _timed(events: DataFrame, time: str, watermark: str) -> DataFrame:
    """Watermarks need a timestamp with zone; times without one are read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def counts_by_window(events: DataFrame, window: str = "7 days", start: str = "4 days", watermark: str = WATERMARK, time: str = "ts") -> DataFrame:
    """Events by type in tumbling windows; with the default offset the windows are weeks that begin on Monday."""
    if events.isStreaming:
        events = _timed(events, time, watermark)
    return events.groupBy(F.window(time, window, startTime=start), "event_type").agg(F.count("*").alias("events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("bucket"), "event_type", "events")


def deduplicated(events: DataFrame, key: str = "event_id", watermark: str = WATERMARK, time: str = "ts") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    if events.isStreaming:
        return _timed(events, time, watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def each_batch_once(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], done: Callable[[], int]) -> StreamingQuery:
    """Hand each batch on; one that ``done`` says was handled before a restart is left out."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: handle(df, n) if n > done() else None).start()
