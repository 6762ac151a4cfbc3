"""Mergeable histograms over streams: the same bins, added up window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxframe.functions.scalar import log_bin


def windowed_histogram(events: DataFrame, time: str, value: str, width: str, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, keys, bin, n) of each tumbling window; on a stream, rows later than `late` behind the newest are dropped.

    State is at most 256 counts for each key of an open window.
    """
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(time, width), *keys, log_bin(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "bin", "n")


def follow_reports(reports: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """A running table `name` of the latest record of each level, from a stream of run records."""
    latest = reports.groupBy("level").agg(F.max_by(F.struct("iteration", "d99_mm", "reason"), "iteration").alias("last")).select("level", "last.*")
    return latest.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
