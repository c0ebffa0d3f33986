"""Intraday bounds of the deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .premium import BPS, require


def add_intraday_premium(df: DataFrame, nav_col: str = "nav") -> DataFrame:
    """Adds the deviation at the day's high and low and their distance."""
    require(df, "high", "low", nav_col)
    bps = lambda c: (F.try_divide(F.col(c), F.col(nav_col)) - 1) * BPS
    out = df.withColumns({"premium_high_bps": bps("high"), "premium_low_bps": bps("low")})
    return out.withColumn("premium_range_bps", F.col("premium_high_bps") - F.col("premium_low_bps"))


def profile_intraday(df: DataFrame) -> DataFrame:
    """Per key: rows, median range, median close deviation and their ratio, share of rows that straddle zero, median unwound.

    Rows with missing values count, and straddle nothing; medians leave them out.
    """
    require(df, "premium_bps", "premium_high_bps", "premium_low_bps", "premium_range_bps")
    hi, lo, at = F.col("premium_high_bps"), F.col("premium_low_bps"), F.col("premium_bps")
    far = F.when(F.abs(hi) >= F.abs(lo), hi).otherwise(lo)
    out = df.groupBy("ticker").agg(
        F.count("*").alias("n"), F.median("premium_range_bps").alias("median_range_bps"), F.median(F.abs(at)).alias("median_close_bps"),
        (F.avg(F.coalesce((hi > 0) & (lo < 0), F.lit(False)).cast("double")) * 100).alias("pct_straddle"), F.median(F.abs(far - at)).alias("median_unwound_bps"),
    )
    ratio = F.when(F.col("median_close_bps") > 0, F.col("median_range_bps") / F.col("median_close_bps")).when(F.col("median_close_bps").isNotNull(), F.lit(float("inf")))
    return out.withColumn("range_to_close", ratio)
