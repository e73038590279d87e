"""Structured Streaming over events. An extension: the screening application itself has no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under path."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and event-time window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def newest_state(events: DataFrame, key: list[str]) -> DataFrame:
    """The newest event of each key so far: the nightly upsert as a stream (update mode)."""
    return events.groupBy(*key).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select(*key, "x.*")
