"""How fast deviations revert: AR(1) with robust errors, half-lives, unit-root test and resolution labels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import finite, normal_p, student_p, z_value

from .flags import by_date


def pairs(df: DataFrame, value: str = "x") -> DataFrame:
    """(ticker, date, x, y): consecutive finite values, adjacency taken after dropping the others."""
    rows = df.where(finite(value)).select("ticker", "date", F.col(value).cast("double").alias("y"))
    return rows.withColumn("x", F.lag("y").over(by_date())).where("x IS NOT NULL")


def fit_ar1(df: DataFrame, value: str = "x", cov_type: str = "HC1", p_value: bool = True, least: int = 3) -> DataFrame:
    """Per key: intercept a, slope b, standard error, t (p), residual sd, n pairs.

    Keys with fewer than ``least`` values get status 'too_short' and no estimates.
    """
    if cov_type not in ("HC1", "nonrobust"):
        raise ValueError(f"unknown covariance {cov_type!r}")
    # moments first, residuals second: the small per-key fit joins back to the pairs
    p = pairs(df, value)
    fit = p.groupBy("ticker").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mx"))
    e = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    d = F.col("x") - F.col("mx")
    both = p.join(fit, "ticker").groupBy("ticker", "a", "b").agg(F.count("*").alias("n"), F.sum(d * d).alias("sxx"), F.sum(d * d * e * e).alias("meat"), F.sum(e * e).alias("sse"))
    dof = F.when(F.col("n") > 2, F.col("n") - 2)
    variance = F.try_divide(F.col("n") * F.col("meat"), dof * F.col("sxx") * F.col("sxx")) if cov_type == "HC1" else F.try_divide(F.col("sse"), dof * F.col("sxx"))
    out = both.select("ticker", "a", "b", F.sqrt(variance).alias("b_se"), F.sqrt(F.try_divide("sse", dof)).alias("resid_sd"), "n")
    short = F.col("n") + 1 < least
    blank = lambda c: F.when(~short, F.col(c)).alias(c)
    out = out.select("ticker", blank("a"), blank("b"), blank("b_se"), blank("resid_sd"), "n", F.when(short, "too_short").otherwise("ok").alias("status"))
    out = out.withColumn("t_stat", F.try_divide("b", "b_se"))
    if not p_value:
        return out
    p_of = normal_p(F.col("t_stat")) if cov_type == "HC1" else student_p(F.col("t_stat"), (F.col("n") - 2).cast("double"))
    return out.withColumn("p_value", p_of)


def half_life(b: Column) -> Column:
    """ln 2 / -ln b for 0 < b < 1, else null."""
    return F.when((b > 0) & (b < 1), F.lit(math.log(2)) / -F.ln(b))


def half_life_to_kappa(c: Column) -> Column:
    return F.when(c > 0, F.lit(math.log(2)) / c)


kappa_to_half_life = half_life_to_kappa


def long_run(a: Column, b: Column) -> Column:
    """The level that the process reverts to; null at b = 1."""
    return F.try_divide(a, 1 - b)


def delta_interval(b: Column, b_se: Column, level: float = 0.95) -> Column:
    """Struct (lower, upper) of the half-life by the delta method; nulls if undefined."""
    h = half_life(b)
    se = F.abs(F.lit(math.log(2)) / (b * F.pow(F.ln(b), 2))) * b_se
    ok = h.isNotNull() & (b_se > 0)
    z = z_value(level)
    return F.struct(F.when(ok, F.greatest(h - z * se, F.lit(0.0))).alias("lower"), F.when(ok, h + z * se).alias("upper"))


def overlaps(lo_a: Column, up_a: Column, lo_b: Column, up_b: Column) -> Column:
    """Inclusive overlap; an undefined interval overlaps everything."""
    undefined = lo_a.isNull() | up_a.isNull() | lo_b.isNull() | up_b.isNull()
    return F.when(undefined, True).otherwise((lo_a <= up_b) & (lo_b <= up_a))


def mackinnon_p(t: float) -> float:
    """Response surface for the constant-only case; fixed values from the published table."""
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    low, high = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(low if t <= -1.61 else high)))


def adf(x) -> tuple:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with constant, lags chosen by AIC."""
    import numpy as np

    x = np.asarray(x, float)
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        return None, None, None
    d = np.diff(x)

    def design(p: int, drop: int):
        rows = np.arange(drop, len(d))
        return d[rows], np.column_stack([np.ones(len(rows)), x[rows], *(d[rows - i] for i in range(1, p + 1))])

    def fit(p: int, drop: int):
        y, z = design(p, drop)
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        return y, z, beta, float(((y - z @ beta) ** 2).sum())

    def aic(p: int) -> float:
        y, z, _, sse = fit(p, most)
        return len(y) * math.log(max(sse, 1e-300) / len(y)) + 2 * z.shape[1]

    p = min(range(most + 1), key=aic)
    y, z, beta, sse = fit(p, p)
    dof = len(y) - z.shape[1]
    if dof <= 0:
        return None, None, None
    se = math.sqrt(sse / dof * np.linalg.pinv(z.T @ z)[1, 1])
    if se == 0:
        return None, None, None
    t = float(beta[1] / se)
    return t, mackinnon_p(t), p


def adf_test(df: DataFrame, value: str = "x") -> DataFrame:
    """Per key: adf_stat, adf_p, lags.  One series has to be in one place for its nested regressions."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("date")
        t, p, k = adf(pdf["x"].to_numpy())
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "adf_stat": [t], "adf_p": [p], "lags": [k]})

    rows = df.where(finite(value)).select("ticker", F.col("date").cast("timestamp").alias("date"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("ticker").applyInPandas(run, "ticker string, adf_stat double, adf_p double, lags long")


def width(lower: Column, upper: Column) -> Column:
    return upper - lower


def is_defined(lower: Column, upper: Column) -> Column:
    return finite(lower) & finite(upper)


def contains(lower: Column, upper: Column, value: Column) -> Column:
    """False for an interval without bounds."""
    return F.coalesce((lower <= value) & (value <= upper), F.lit(False))


def show_interval(lower: Column, upper: Column) -> Column:
    return F.when(is_defined(lower, upper), F.format_string("[%.2f, %.2f]", lower, upper)).otherwise("[undefined]")


def estimate_reversion(df: DataFrame, value: str = "x", alpha: float = 0.05, cov_type: str = "HC1", sampling_interval: float = 1.0, least: int = 20, intervals: bool = False, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Per key: AR(1) fit, unit-root test, half-life, resolution label with its reason, and the bound of unresolved keys.

    ``intervals`` adds, for keys with an estimate only, the bootstrap interval (lower, upper, n_valid) and
    that of the delta method (delta_lower, delta_upper), both at level 1 - alpha.
    """
    both = fit_ar1(df, value, cov_type, least=least).join(adf_test(df, value), "ticker", "left")
    h = half_life(F.col("b"))
    label = (
        F.when(F.col("status") != "ok", None)
        .when(F.col("adf_p") > alpha, "unit_root")
        .when(F.col("p_value") > alpha, "unresolved")
        .when(F.col("b") <= 0, "oscillatory")
        .when(h < sampling_interval, "identified_subdaily")
        .otherwise("identified")
    )
    out = both.withColumn("resolution", label)
    known = F.col("resolution").isin("identified", "identified_subdaily")
    is_, bound = lambda k: F.col("resolution") == k, half_life(F.col("b") + 1.96 * F.col("b_se"))
    fitted = F.coalesce(F.format_string("%.2f", h), F.lit("n/a"))
    shown = F.when(h.isNull(), F.lit("n/a")).otherwise(fitted)
    most = F.when(bound.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f", bound))
    out = out.withColumns({
        "half_life": F.when(known, h),
        "bound": F.when(is_("unresolved"), bound),
        "display": F.when(is_("identified"), F.format_string("%.2f d", h))
        .when(is_("identified_subdaily"), F.format_string("%.2f d (sub-daily)", h))
        .when(is_("unresolved"), F.format_string("< %s d (unresolved, fit %s)", most, shown))
        .when(F.col("resolution").isNotNull(), F.format_string("n/a (%s)", "resolution")),
        "reason": F.when(is_("unit_root"), F.format_string(f"unit-root test p=%.3f is above {alpha}: a half-life would grow with the sample", "adf_p"))
        .when(is_("unresolved"), F.format_string(f"slope p=%.3f is above {alpha}: only an upper bound of %s can be given, the fit says %s", F.col("p_value"), most, shown))
        .when(is_("oscillatory"), F.format_string("slope %.4f is negative: values alternate and no half-life exists", "b"))
        .when(is_("identified_subdaily"), F.format_string(f"half-life %.2f is below the sampling interval {sampling_interval:g}: an order of magnitude only", h))
        .when(is_("identified"), F.format_string("unit-root test p=%.3g and slope p=%.3g both reject", F.col("adf_p"), F.col("p_value")))
        .otherwise(F.format_string(f"fewer than {least} values")),
    })
    if not intervals:
        return out
    from .bootstrap import bootstrap_interval

    drawn = bootstrap_interval(df.join(out.where(known).select("ticker"), "ticker", "left_semi"), value, n_boot, 1 - alpha, seed=seed)
    delta = delta_interval(F.col("b"), F.col("b_se"), 1 - alpha)
    out = out.withColumns({"delta_lower": F.when(known, delta["lower"]), "delta_upper": F.when(known, delta["upper"])})
    return out.join(drawn, "ticker", "left")
