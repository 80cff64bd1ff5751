"""Ticks to candles as a stream: tumbling windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_candles(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Candles of a (possibly streaming) frame of ticks (asset, ts, price, quantity, turn); a bar closes once the watermark
    has passed its end, so that an unfinished bar never leaves in append mode. Bars are unbounded in number, not in state."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    turn = F.struct("ts", "turn")
    bars = rows.groupBy("asset", F.window("ts", width).alias("w")).agg(F.min_by("price", turn).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", turn).alias("close"), F.sum("quantity").alias("volume"))
    return bars.select("asset", F.col("w.start").cast("timestamp_ntz").alias("begin"), "open", "high", "low", "close", "volume")
