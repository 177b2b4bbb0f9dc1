"""An extension, not part of what the engine covers: stage events as a stream, with the batch query's last-write-wins result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count and total of value for each event type and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def replay(traces: DataFrame) -> DataFrame:
    """A finished trace as ordered events: one for each candidate in its final order, then the answer."""
    shown = traces.select("config_id", "query_id", F.posexplode("candidates").alias("seq", "c")).select("config_id", "query_id", "seq", F.lit("candidate").alias("type"), F.col("c.chunk_id").alias("payload"))
    done = traces.select("config_id", "query_id", F.lit(1_000_000).alias("seq"), F.lit("done").alias("type"), F.col("answer").alias("payload"))
    return shown.union(done)
