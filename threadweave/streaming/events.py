"""Structured Streaming over event files, each with the batch form that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", late: str = "1 hour") -> DataFrame:
    """The events of a folder's files as a stream, ts as timestamp with a watermark."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """Each event id once; the state goes with the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total."""
    g = events.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w") if not events.isStreaming else F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """session_start, session_end (last event plus gap), event_type, n: runs of events of a type at most `gap` apart."""
    ts = F.col("ts") if events.isStreaming else F.col("ts").cast("timestamp")
    g = events.groupBy(F.session_window(ts, gap).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_type", "n")


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; a restart goes on from the checkpoint without repeating rows."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
