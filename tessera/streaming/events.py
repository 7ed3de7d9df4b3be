"""Event streams: windows, sessions and duplicates under a watermark. An addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WATERMARK = "1 hour"


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def distinct_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, size: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    own = events.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 days", slide: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    own = events.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    own = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, to Parquet, and read the result."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drained_whole(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregated stream over what there is and read its last state: late rows count, open windows are there.

    Each batch writes the state anew in complete mode, in which no watermark drops rows,
    so the result does not depend on the order or number of the files.
    """
    spark = stream.sparkSession
    put = lambda state, _: state.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
