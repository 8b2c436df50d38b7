"""Structured Streaming counterparts of polling and of the tool log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def event_stream(spark: SparkSession, base: str, late: str = LATE) -> DataFrame:
    """The events folder or file as a stream with event time `at`."""
    batch = spark.read.parquet(f"{base}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(base)
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def calls_per_window(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """`start`, `tool`, calls and mean of tumbling or sliding windows."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return events.groupBy(w.alias("w"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "tool", "n", "mean")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """`user_id`, `start`, `n` of bursts of events that end with a quiet period."""
    return events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str) -> DataFrame:
    """Every key once while its time is within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later run with the same checkpoint takes only what came since."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def watch_files(spark: SparkSession, root: str) -> DataFrame:
    """New and changed files as a stream of `path`, `mtime`, `size`; settle() turns them into rescans."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return stream.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"))


def settle(changes: DataFrame, quiet: str) -> DataFrame:
    """One row per burst of changes: `start`, `end`, `n_files`."""
    c = changes.withWatermark("at", quiet)
    return c.groupBy(F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n_files")).select("w.start", "w.end", "n_files")
