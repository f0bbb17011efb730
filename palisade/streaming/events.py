"""Event-time windows over a stream or a table of events; the same plan serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value by window and event type; on a stream, windows close after `late`."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    grouped = stamped.groupBy(F.window("ts", every).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def follow(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, every: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Windows of Parquet files that arrive in a folder, appended to target as they close."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = windowed(stream, every, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).format("parquet").start(target)
