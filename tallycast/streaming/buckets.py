"""The bucketing step on a stream: the batch operator under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallycast.operators.panel import bucket_counts


def stream_bucket_counts(events: DataFrame, sid: str, ts: str = "ts", minutes: int = 15, lateness: str = "1 hour") -> DataFrame:
    """Counts per series and step; a step is final once the watermark has passed it.

    State holds one row per open (step, series), whatever the event rate.
    """
    # watermarks need an instant; with the session zone fixed at UTC the wall clock is unchanged
    timed = events.withColumn(ts, events[ts].cast("timestamp")).withWatermark(ts, lateness)
    return bucket_counts(timed, sid, ts, minutes)


def write_buckets(counts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append final steps to a parquet table."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
