"""Event-time bars from a stream (an extension: the batch operators don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Tumbling bars of ``ts, event_type, value, event_id``; a bar is final once the watermark passes its end.

    Events later than ``lateness`` are dropped, so a bar is only ever available after its close.
    """
    rows = events.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    order = F.struct("ts", "event_id")
    return rows.groupBy(F.window("ts", length).alias("w"), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    ).select(F.col("w.start").alias("session"), "ticker", "open", "high", "low", "close", "volume")


def run_available(bars: DataFrame, path: str, checkpoint: str) -> None:
    """Write final bars of all that is there and stop; a restart goes on where the checkpoint ends."""
    query = bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
