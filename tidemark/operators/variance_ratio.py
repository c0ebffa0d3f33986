"""Heteroskedasticity-robust variance ratios; all horizons in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import finite, normal_p

from .flags import by_date


def variance_ratios(df: DataFrame, value: str = "x", horizons: tuple = (2, 5, 10, 20), p_value: bool = True) -> DataFrame:
    """Per key and horizon: ratio, z (p), n; keys with fewer than ten times the horizon get nulls."""
    if min(horizons) < 2:
        raise ValueError("horizons start at 2")
    x = F.col("v")
    rows = df.where(finite(value)).select("ticker", "date", F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("d", x - F.lag(x).over(by_date()))
    rows = rows.withColumn("mu", F.avg("d").over(Window.partitionBy("ticker")))
    rows = rows.withColumn("c", F.pow(F.col("d") - F.col("mu"), 2))
    most = max(horizons)
    lagged = {f"x{q}": F.lag("v", q).over(by_date()) for q in horizons} | {f"c{j}": F.lag("c", j).over(by_date()) for j in range(1, most)}
    rows = rows.withColumns(lagged)
    sums = [F.count("d").alias("m"), F.sum("c").alias("sc")]
    sums += [F.sum(F.pow(x - F.col(f"x{q}") - q * F.col("mu"), 2)).alias(f"q{q}") for q in horizons]
    sums += [F.sum(F.col("c") * F.col(f"c{j}")).alias(f"s{j}") for j in range(1, most)]
    one = rows.groupBy("ticker").agg(*sums)

    def entry(q: int):
        m = F.col("m").cast("double")
        var1 = F.col("sc") / F.nullif(m - 1, F.lit(0.0))
        varq = F.try_divide(F.col(f"q{q}"), q * (m - q + 1) * (1 - F.try_divide(F.lit(float(q)), m)))
        ratio = F.when(m + 1 >= 10 * q, F.try_divide(varq, var1))
        theta = sum(((2 * (q - j) / q) ** 2 * F.col(f"s{j}") for j in range(1, q)), F.lit(0.0))
        theta = F.try_divide(theta, F.col("sc") * F.col("sc"))
        return F.struct(F.lit(q).alias("horizon"), (F.col("m") + 1).alias("n"), ratio.alias("ratio"), F.when(theta > 0, (ratio - 1) / F.sqrt(theta)).alias("z"))

    out = one.select("ticker", F.explode(F.array(*(entry(q) for q in horizons))).alias("e")).select("ticker", "e.*")
    return out.withColumn("p_value", normal_p(F.col("z"))) if p_value else out


def profile(ratios: DataFrame, critical: float = 1.959964) -> DataFrame:
    """Per key: all ratios below one, non-increasing in the horizon, and whether mean reversion is confirmed."""
    rejects = F.coalesce(F.abs("z") > critical, F.lit(False))
    after = F.lead("ratio").over(Window.partitionBy("ticker").orderBy("horizon"))
    rows = ratios.withColumns({"rejects": rejects, "falls": F.coalesce(after <= F.col("ratio"), F.lit(True))})
    out = rows.groupBy("ticker").agg(F.coalesce(F.bool_and(F.col("ratio") < 1), F.lit(False)).alias("all_below_one"), F.bool_and("falls").alias("monotone_decreasing"), F.bool_or("rejects").alias("any_rejects"))
    return out.withColumn("confirms_mean_reversion", F.col("all_below_one") & F.col("any_rejects"))
