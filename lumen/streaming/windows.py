"""An extension: windowed summaries of event streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows, mean and extremes of value for each key and tumbling window; rows later than ``late`` are dropped by the watermark of a stream."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if stream.isStreaming else timed
    g = timed.groupBy(F.window("_ts", length), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.select(F.col("window.start").alias("start"), by, "n", "mean", "min", "max")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows of each session of a key, ended by a gap."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if stream.isStreaming else timed
    g = timed.groupBy(F.session_window("_ts", gap), by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
