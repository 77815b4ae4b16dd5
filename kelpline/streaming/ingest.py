"""Streams: incremental ingest of documents into an index, and request counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings, word_occurrences


def ingest(stream: DataFrame, index_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds the postings of each batch of new documents as a part of the index.

    A part is one folder named by its batch, so a batch that is repeated after a failure replaces itself.
    """

    def batch(df: DataFrame, n: int) -> None:
        postings(word_occurrences(df)).write.mode("overwrite").parquet(f"{index_path}/part={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def request_rates(events: DataFrame, window: str = "1 minute", late: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Requests by window and type; events later than `late` behind the newest are dropped."""
    at = F.col(ts).cast("timestamp")
    counted = events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("begin"), "event_type", "n")
