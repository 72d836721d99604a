"""Requests as a stream: stored as they come, and counted by hour with late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalith.sources.stores import valid_requests


def store_requests(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the valid requests of a stream (list_id, url, at) to a Parquet table, each once."""
    rows = valid_requests(stream.withColumnRenamed("at", "_at"), F.col("_at"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_requests(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests of each listing and hour (list_id, hour, n); state older than the watermark goes."""
    hour = F.window("at", "1 hour")
    counted = stream.where("list_id is not null").withWatermark("at", late).groupBy("list_id", hour.alias("w")).agg(F.count("*").cast("long").alias("n"))
    return counted.select("list_id", F.col("w.start").alias("hour"), "n")
