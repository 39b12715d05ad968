"""Streaming extraction: pages that arrive as files become annotated edges, once each.

A file source with a checkpoint replaces the batch-and-flush loop: each micro-batch is annotated and
appended under its batch id, so a batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from forkline.sources import html


def page_stream(spark: SparkSession, folder: str, pattern: str = "*.htm", files: int = 50) -> DataFrame:
    """(page_id, html) of new files, at most ``files`` a batch."""
    raw = spark.readStream.option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).format("text").load(folder)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"sect([^/]*)\.htm$", 1).alias("page_id"), F.col("value").alias("html"))


def append_edges(pages: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts the query; stops by itself when all files present are done."""

    def batch(df: DataFrame, number: int) -> None:
        annotate(html.parse_pages(df)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_shares(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and time window of an event stream, late rows up to ``late``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
