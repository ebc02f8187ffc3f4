"""Streams of feedback and traces: event-time windows with a watermark; late rows are kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files of a folder as a stream, with event time as a TIMESTAMP."""
    x = spark.readStream.schema(schema).parquet(path)
    return x.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(x: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their mean value by tumbling window and kind, closed once the watermark has passed."""
    by = x.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("window.start", "event_type", "n", "mean_value")


def ingest(x: DataFrame, out: str, checkpoint: str):
    """Append closed windows to Parquet; reads what is there and ends."""
    return x.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
