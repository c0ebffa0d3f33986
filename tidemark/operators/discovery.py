"""Does the deviation lead another series?  Regressions on that series' own calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flags import by_date
from .premium import BPS


def regress(df: DataFrame, y: str, x: str, keys: list | None = None, least: int = 30) -> DataFrame:
    """Per key: slope, classical t, R squared and n; null below ``least`` pairs."""
    keys = keys or ["ticker"]
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    se = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("syy"), F.col("sxx") * F.nullif(F.col("n") - 2, F.lit(0))))
    blank = lambda c, name: F.when(F.col("n") >= least, c).alias(name)
    return out.select(*keys, blank(F.col("slope"), "slope"), blank(F.try_divide(F.col("slope"), se), "t_stat"), blank(F.col("r2"), "r2"), "n")


def target_returns(level: DataFrame, horizon: int = 1) -> DataFrame:
    """(ticker, date, lead_bps, same_bps, lag_bps) of a level series, shifted before any join."""
    ret = level.withColumn("ret", (F.try_divide(F.col("level"), F.lag("level").over(by_date())) - 1) * BPS)
    return ret.select("ticker", "date", F.lead("ret", horizon).over(by_date()).alias("lead_bps"), F.col("ret").alias("same_bps"), F.lag("ret", horizon).over(by_date()).alias("lag_bps"))


def premium_with_target(premium: DataFrame, level: DataFrame, horizon: int = 1) -> DataFrame:
    """Inner join of the deviation with the shifted returns; ``level``: (ticker, date, level)."""
    return premium.select("ticker", "date", "premium_bps").join(target_returns(level, horizon), ["ticker", "date"])


def measure_price_discovery(premium: DataFrame, level: DataFrame, horizon: int = 1, external: bool = True) -> DataFrame:
    """Per key: outcome and placebo regressions and the verdict."""
    both = premium_with_target(premium, level, horizon)
    lead = regress(both.dropna(subset=["premium_bps", "lead_bps"]), "lead_bps", "premium_bps")
    back = regress(both.dropna(subset=["premium_bps", "lag_bps"]), "lag_bps", "premium_bps").select("ticker", F.col("r2").alias("placebo_r2"), F.col("slope").alias("placebo_slope"))
    verdict = (F.col("slope") > 0.2) & (F.abs("t_stat") > 3) & (F.col("r2") > 0.02) & (F.col("r2") > 4 * F.col("placebo_r2"))
    return lead.join(back, "ticker").withColumn("is_price_discovery", F.coalesce(verdict, F.lit(False))).withColumn("external", F.lit(external))


def gap_session(bars: DataFrame) -> DataFrame:
    """(ticker, date, gap, session, total): the next bar's returns in bps, split at its open."""
    before = F.lag("close").over(by_date())
    r = bars.select("ticker", "date", ((F.try_divide(F.col("open"), before) - 1) * BPS).alias("g"), ((F.try_divide(F.col("close"), F.col("open")) - 1) * BPS).alias("s"), ((F.try_divide(F.col("close"), before) - 1) * BPS).alias("t"))
    return r.select("ticker", "date", F.lead("g").over(by_date()).alias("gap"), F.lead("s").over(by_date()).alias("session"), F.lead("t").over(by_date()).alias("total"))


def gap_share(premium: DataFrame, bars: DataFrame) -> DataFrame:
    """Per key: slopes of gap, session and total on the deviation, and the share of the slope in the gap."""
    both = premium.select("ticker", "date", "premium_bps").join(gap_session(bars), ["ticker", "date"]).dropna()
    out = both.groupBy("ticker").agg(*(F.regr_slope(c, "premium_bps").alias(f"slope_{c}") for c in ("gap", "session", "total")), F.count("*").alias("n"))
    return out.withColumn("gap_share", F.try_divide("slope_gap", "slope_total"))
