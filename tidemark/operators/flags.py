"""Quality flags: stale values and extreme deviations are marked, never removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .premium import BPS, require

def by_date():
    """Rows of a key in order of date; made on call, as it needs a session."""
    return Window.partitionBy("ticker").orderBy("date")



def add_quality_flags(df: DataFrame, band_bps: float | None = None, price_move_bps: float = 25.0, nav_move_bps: float = 1.0) -> DataFrame:
    """Adds nav_unchanged, stale_nav and extreme_premium; ``band_bps`` None takes a column of that name."""
    require(df, "close", "nav", "premium_bps")
    if band_bps is not None and band_bps <= 0:
        raise ValueError("band_bps must be positive")
    move = lambda c: F.abs(F.try_divide(F.col(c), F.lag(c).over(by_date())) - 1) * BPS
    band = F.col("band_bps") if band_bps is None else F.lit(band_bps)
    still = F.coalesce(move("nav") <= nav_move_bps, F.lit(False))
    return df.withColumns({
        "nav_unchanged": still,
        "stale_nav": still & (F.coalesce(move("close"), F.lit(0.0)) > price_move_bps),
        "extreme_premium": F.coalesce(F.abs("premium_bps") > band, F.lit(False)),
    })


def longest_run(df: DataFrame, flag: str = "nav_unchanged") -> DataFrame:
    """Per key: length of the longest run of consecutive rows with the flag."""
    island = F.sum((~F.col(flag)).cast("long")).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("island", island).groupBy("ticker", "island").agg(F.count_if(F.col(flag)).alias("length"))
    return runs.groupBy("ticker").agg(F.max("length").alias("longest_run"))


def quality_report(flagged: DataFrame, dates: bool = False) -> DataFrame:
    """Per key: counts and shares of flagged rows, the longest unchanged run (and the dates)."""
    aggs = [F.count("*").alias("n_obs"), F.count_if("stale_nav").alias("n_stale"), F.count_if("extreme_premium").alias("n_extreme")]
    if dates:
        aggs += [F.array_sort(F.collect_list(F.when(F.col(c), F.col("date")))).alias(n) for c, n in (("stale_nav", "stale_dates"), ("extreme_premium", "extreme_dates"))]
    out = flagged.groupBy("ticker").agg(*aggs).join(longest_run(flagged), "ticker")
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n_obs")), F.lit(0.0))
    return out.withColumns({"pct_stale": share("n_stale"), "pct_extreme": share("n_extreme")})


def largest(df: DataFrame, k: int = 5) -> DataFrame:
    """The k rows per key with the largest deviation in absolute terms."""
    w = Window.partitionBy("ticker").orderBy(F.abs("premium_bps").desc(), "date")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
