"""Extension, no parity claim: windows over events in batches and streams, with the same expressions for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def tumbling(events: DataFrame, ts: str = "ts", length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with a watermark where events is a stream.

    Watermarks take instants only, so a time without zone is read as UTC under one and given back without zone.
    """
    zoneless = bool(late) and events.isStreaming and events.schema[ts].dataType == T.TimestampNTZType()
    if zoneless:
        events = events.withColumn(ts, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`))"))
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    got = events.groupBy(F.window(ts, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    start = F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {_EPOCH})") if zoneless else F.col("w.start")
    return got.select(start.alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    got = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def profile_stream(events: DataFrame, sink: str, checkpoint: str, late: str = "10 minutes"):
    """A query that appends windowed profiles of a stream to Parquet; restart-safe through its checkpoint."""
    return tumbling(events, late=late).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
