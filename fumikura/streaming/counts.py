"""Incremental counts over token arrivals and events, by Structured Streaming.

The same plans run on a batch, which is their oracle.  Timestamps without zone are cast first (a watermark needs an
instant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(df: DataFrame, key: str, ts: str = "ts", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and sums per window and key; tumbling, or sliding with ``slide``."""
    w: Column = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = df.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key: their start and number of events."""
    g = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "n")


def first_arrivals(df: DataFrame, *keys: str) -> DataFrame:
    """Each key once within the watermark: the streaming form of "already have it"."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def run(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a finite stream to its end into an in-memory table; for tests and small results."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
