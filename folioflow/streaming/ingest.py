"""Incremental ingest: new chunks arrive as a stream, repeats are dropped, and the table grows by append only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.sources.files import chunk_id


def chunk_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of chunks as they appear under ``path``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each natural key once: state is kept for rows up to ``delay`` behind, by event time, and then given up."""
    timed = stream.withColumn("event_time", F.col("ingested_at").cast("timestamp"))
    return timed.withColumn("id", chunk_id()).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


def arrivals(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Chunks by source and window of event time, final once the watermark has passed."""
    timed = stream.withColumn("event_time", F.col("ingested_at").cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window), "source").agg(F.count("*").alias("chunks")).select(F.col("window.start").alias("day"), "source", "chunks")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, exactly once, into a Parquet table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
