"""Usage charges on a stream: lifetime totals and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_totals(charges: DataFrame) -> DataFrame:
    """(user_id, cost_total, request_count), for update or complete mode; the state is one row for each user."""
    return charges.groupBy("user_id").agg(F.round(F.sum("cost"), 6).alias("cost_total"), F.count(F.lit(1)).alias("request_count"))


def stream_windows(charges: DataFrame, width: str = "180 seconds", slide: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, cost) of sliding windows; windows are dropped from the state when the watermark passes them."""
    timed = charges.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    return timed.groupBy("user_id", F.window("at", width, slide).alias("w")).agg(F.round(F.sum("cost"), 6).alias("cost")).select("user_id", F.col("w.start").alias("start"), "cost")
