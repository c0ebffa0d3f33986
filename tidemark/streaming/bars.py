"""Optional extension: bars and deviations of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.premium import add_premium


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ticker, date, open, high, low, close, nav, volume, premium, premium_bps) of windows that the watermark has closed."""
    w = F.window("ts", width)
    bars = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("ticker"), w.alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.avg("value").alias("nav"), F.count("*").alias("volume")
    )
    return add_premium(bars.select("ticker", F.col("w.start").alias("date"), "open", "high", "low", "close", "nav", "volume"))
