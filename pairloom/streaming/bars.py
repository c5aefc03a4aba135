"""Extension: bars and a regime flag over a stream of events. The batch operators stay the measure of parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of (ts, event_type, value); works on a stream (late rows beyond `late` go) and on a table."""
    e = events.withColumn("t", F.col("ts").cast("timestamp"))
    e = e.withWatermark("t", late) if events.isStreaming else e
    g = e.groupBy(F.window("t", width).alias("w"), F.col("event_type").alias("sym")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.count("*").alias("volume"))
    return g.select("sym", F.col("w.start").cast("timestamp_ntz").alias("ts"), "high", "low", "mean", "volume")


def run_once(events: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drains what is there through the streaming plan into a memory table."""
    q = windowed_bars(events).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return events.sparkSession.table(name)
