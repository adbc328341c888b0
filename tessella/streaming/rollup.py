"""Structured Streaming over event logs: watermarked roll-ups and single-use records.

An addition of ours: the batch operators re-read their logs in full, these keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of ``folder`` as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rollup(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and event type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def single_use(events: DataFrame, key: str = "event_id", age: str = "60 seconds") -> DataFrame:
    """Each record once: a repeat within ``age`` is dropped, and state older than that goes."""
    return events.withWatermark("ts", age).dropDuplicatesWithinWatermark([key])
