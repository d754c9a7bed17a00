"""Event-time windows: the streaming counterpart of coordinate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_values(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per window and event type: n, total, least and greatest value; works on streams.

    Rows later than ``late`` behind the newest are dropped by the watermark, which also
    bounds the state that is kept.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "least", "most")
