"""Incremental ingestion and windowed reports with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from evispark.sources.files import PAPER_RECORD


def paper_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of structured papers, as they arrive."""
    return spark.readStream.schema(PAPER_RECORD).option("maxFilesPerTrigger", files_a_batch).json(path)


def ingest(papers: DataFrame, out: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Appends each batch's vertex and edge tables under ``out``; what is there when it starts is taken in and it stops.

    The checkpoint makes a restart resume after the last finished batch. A batch writes
    into a folder of its own number, so one that is repeated after a failure replaces
    its rows instead of adding them twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, df in tables(batch).items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by time window and key, with a watermark; for batch tables the same rows in one go."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    marked = events.withWatermark(at, late) if events.isStreaming else events
    g = marked.groupBy(window.alias("w"), key).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n_events", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of events less than ``gap`` apart."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    g = marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_of_each(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
