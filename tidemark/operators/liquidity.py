"""Dollar volume and the two-day high-low spread estimator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flags import by_date
from .premium import BPS, refuse, require


def high_low_spread(high: str = "high", low: str = "low", close: str | None = None, clip: bool = False) -> Column:
    """Corwin-Schultz spread of each day and the day before; day two moves by the overnight gap if ``close`` is given.

    Rows whose high is below the low, or whose prices are not positive, are refused.
    """
    bad = (F.col(high) < F.col(low)) | (F.col(high) <= 0) | (F.col(low) <= 0)
    h2, l2 = refuse(bad, "impossible high and low", F.col(high)), F.col(low)
    h1, l1 = F.lag(high).over(by_date()), F.lag(low).over(by_date())
    if close is not None:
        before = F.lag(close).over(by_date())
        gap = F.coalesce(F.greatest(before - h2, F.lit(0.0)) - F.greatest(l2 - before, F.lit(0.0)), F.lit(0.0))
        h2, l2 = h2 + gap, l2 + gap
    square = lambda a, b: F.pow(F.ln(F.try_divide(a, b)), 2)
    beta = square(h1, l1) + square(h2, l2)
    gamma = square(F.when(h1.isNotNull(), F.greatest(h1, h2)), F.least(l1, l2))
    k1 = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k1 - F.sqrt(gamma / k1)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))) if clip else spread


def profile_liquidity(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Per key: dollar volume, spread in bps unclipped and clipped, share of negative estimates, median daily range.

    ``digits`` rounds spreads first, so that two engines agree on which are below zero.
    """
    require(df, "high", "low", "close", "volume")
    spread = high_low_spread(close="close")
    rows = df.withColumn("spread", spread if digits is None else F.round(spread, digits)).withColumn("dollars", F.col("close") * F.col("volume"))
    out = rows.groupBy("ticker").agg(
        F.median("dollars").alias("median_dollar_volume"), F.avg("dollars").alias("mean_dollar_volume"),
        (F.avg("spread") * BPS).alias("spread_bps"), (F.avg(F.when(F.col("spread").isNotNull(), F.greatest("spread", F.lit(0.0)))) * BPS).alias("spread_clipped_bps"),
        (F.avg((F.col("spread") < 0).cast("double")) * 100).alias("pct_negative"),
        F.median((F.col("high") - F.col("low")) / F.col("close") * BPS).alias("median_range_bps"),
    )
    return out.withColumn("spread_is_usable", F.coalesce(F.col("spread_bps") > 0, F.lit(False)))
