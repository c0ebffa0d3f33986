"""Relative deviation of price from published value, in basis points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import student_p

BPS = 10_000


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def refuse(bad: Column, message: str, value: Column) -> Column:
    """``value``, or an error when a row is ``bad`` as it is computed; costs no pass of its own."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)


def add_premium(df: DataFrame, price_col: str = "close", nav_col: str = "nav", strict: bool = True) -> DataFrame:
    """Adds premium and premium_bps; ``strict`` refuses published values that are missing or not positive."""
    require(df, price_col, nav_col)
    ratio = F.try_divide(F.col(price_col), F.col(nav_col)) - 1
    if strict:
        ratio = refuse(~F.coalesce((F.col(nav_col) > 0) & ~F.isnan(nav_col), F.lit(False)), f"{nav_col} is missing or not positive", ratio)
    return df.withColumns({"premium": ratio, "premium_bps": ratio * BPS})


def describe_premium(df: DataFrame, p_value: bool = True) -> DataFrame:
    """Per key: count, mean, median, sd, range, share above zero, one-sample t against zero (and p)."""
    require(df, "premium_bps")
    x = F.col("premium_bps")
    out = df.where(x.isNotNull()).groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_bps"), F.median(x).alias("median_bps"), F.stddev_samp(x).alias("sd_bps"),
        F.min(x).alias("min_bps"), F.max(x).alias("max_bps"), F.avg((x > 0).cast("double")).alias("frac_positive"),
    )
    out = out.withColumn("t_stat", F.try_divide(F.col("mean_bps"), F.col("sd_bps") / F.sqrt("n")))
    if not p_value:
        return out
    out = out.withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 1).cast("double")))
    return out.withColumn("mean_differs_from_zero", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
