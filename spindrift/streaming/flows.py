"""The same operators over streams: documents cut as they come, repeats dropped within a watermark,
events counted in windows. Each function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.segment import chunks


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, event_type, n, users, total. A stream drops events later than ``late``; its users are
    an estimate, since a stream cannot count distinct values exactly in bounded state."""
    streaming = events.isStreaming
    timed = events.withWatermark("ts", late) if streaming else events
    users = F.approx_count_distinct("user_id", 0.01) if streaming else F.countDistinct("user_id")
    counted = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), users.alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("hour"), "event_type", "n", "users", "total")


def chunk_stream(documents: DataFrame, limit: int = 2000) -> DataFrame:
    """Chunks of every document as it arrives; stateless."""
    return chunks(documents, limit)


def first_deliveries(triples: DataFrame, late: str = "1 day") -> DataFrame:
    """The first delivery of each event_id; a stream keeps ids for ``late`` by loaded_at."""
    if triples.isStreaming:
        return triples.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["event_id"])
    return triples.dropDuplicates(["event_id"])
