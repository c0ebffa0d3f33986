"""The whole cross-section in one plan: every key at once, and its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align, cross_section, flags, intraday, liquidity, reversion, variance_ratio
from tidemark.operators.premium import add_premium, describe_premium


def analyse(prices: DataFrame, navs: DataFrame, universe: DataFrame, start: str | None = None, end: str | None = None, n_boot: int = 2000) -> DataFrame:
    """One row a key: description, quality, reversion with bootstrap interval, liquidity, intraday profile.

    ``universe``: (ticker, sleeve, outlier_band_bps, foreign_session, role); every role is analysed.
    A key that is too short for an estimate has nulls there and does not stop the others.
    """
    panel = add_premium(align.align_price_nav(prices, navs, start, end))
    bands = universe.select("ticker", F.col("outlier_band_bps").alias("band_bps"))
    flagged = flags.add_quality_flags(panel.join(bands, "ticker")).persist()  # read by six branches; as small as the panel
    x = flagged.withColumn("x", F.col("premium_bps"))
    fit = reversion.estimate_reversion(x, intervals=True, n_boot=n_boot).drop("a", "resid_sd", "status", "t_stat", "n", "lags", "adf_stat").withColumnRenamed("p_value", "b_p")
    ratios = variance_ratio.variance_ratios(x)
    ends = ratios.groupBy("ticker").agg(F.min_by("ratio", "horizon").alias("vr_2"), F.max_by("ratio", "horizon").alias("vr_20"))
    out = describe_premium(flagged)
    within = intraday.profile_intraday(intraday.add_intraday_premium(flagged)).drop("n").withColumnRenamed("median_range_bps", "intraday_range_bps")
    for part in (flags.quality_report(flagged), fit, liquidity.profile_liquidity(flagged), within, variance_ratio.profile(ratios), ends):
        out = out.join(part, "ticker", "left")
    out = out.join(universe.select("ticker", "sleeve", "role", "foreign_session", F.col("outlier_band_bps").alias("band_bps")), "ticker")
    return cross_section.results_table(out.withColumn("asset_group", cross_section.asset_group(F.col("sleeve"))))


#: Fixed values: (name in the row, column, digits or none) of the rows that reports hold, by kind.
ROWS = {
    "quality": [("ticker", "ticker", None), ("n_obs", "n_obs", None), ("n_stale_nav", "n_stale", None), ("pct_stale", "pct_stale", 3), ("n_extreme_premium", "n_extreme", None), ("pct_extreme", "pct_extreme", 3), ("longest_nav_run", "longest_run", None), ("band_bps", "band_bps", None)],
    "liquidity": [("ticker", "ticker", None), ("spread_bps", "spread_bps", 3), ("spread_usable", "spread_is_usable", None), ("adv_usd_m", "median_dollar_volume / 1e6", 1), ("range_bps", "median_range_bps", 1)],
    "intraday": [("ticker", "ticker", None), ("foreign_session", "foreign_session", None), ("range_bps", "intraday_range_bps", 1), ("abs_close_bps", "median_close_bps", 1), ("range_over_close", "range_to_close", 2), ("pct_sign_flip", "pct_straddle", 1), ("unwound_bps", "median_unwound_bps", 1)],
    "discovery": [("ticker", "ticker", None), ("target", "target", None), ("slope", "slope", 3), ("t_stat", "t_stat", 1), ("r_squared", "r2", 4), ("placebo_r2", "placebo_r2", 4), ("external", "external", None), ("price_discovery", "is_price_discovery", None)],
    "reversion": [("ticker", "ticker", None), ("n", "n", None), ("b", "b", 6), ("b_se", "b_se", 6), ("adf_pvalue", "adf_p", 6), ("b_zero_pvalue", "double(format_string('%.2e', b_p))", None), ("resolution", "resolution", None), ("half_life", "half_life", None), ("half_life_upper_bound", "bound", None)],
    "results": [("ticker", "ticker", None), ("sleeve", "sleeve", None), ("group", "asset_group", None), ("role", "role", None), ("n", "n", None), ("mean_bps", "mean_bps", 2), ("sd_bps", "sd_bps", 2), ("pct_prem", "frac_positive * 100", 1), ("resolution", "resolution", None), ("half_life", "half_life", 3), ("ci_low", "lower", 3), ("ci_high", "upper", 3), ("half_life_display", "display", None), ("adv_usd_m", "median_dollar_volume / 1e6", 0), ("vr_2", "vr_2", 3), ("vr_20", "vr_20", 3), ("n_stale", "n_stale", None), ("n_extreme", "n_extreme", None)],
}
#: Fixed values: (format, columns) of the lines that consoles show, by kind.
LINES = {
    "premium": ("%s: n=%d mean %+.2fbps sd %.2fbps range %+.0f/%+.0fbps premium on %.1f%% of days", ["ticker", "n", "mean_bps", "sd_bps", "min_bps", "max_bps", "frac_positive * 100"]),
    "quality": ("%s: n=%d stale_nav=%d (%.2f%%) extreme>%.0fbps=%d (%.2f%%) longest_nav_run=%d", ["ticker", "n_obs", "n_stale", "pct_stale", "band_bps", "n_extreme", "pct_extreme", "longest_run"]),
    "liquidity": ("%s: spread %.2fbps ADV $%,.0fm range %.0fbps (n=%d)", ["ticker", "spread_bps", "median_dollar_volume / 1e6", "median_range_bps", "n"]),
    "intraday": ("%s: range %.0fbps vs close %.0fbps (%.1fx), sign flips on %.0f%% of days [%s]", ["ticker", "intraday_range_bps", "median_close_bps", "range_to_close", "pct_straddle", "if(foreign_session, 'frozen basket', 'upper bound only')"]),
    "discovery": ("%s->%s: slope %+.2f t=%+.1f R2=%.3f (placebo %.3f) [%s] %s", ["ticker", "target", "slope", "t_stat", "r2", "placebo_r2", "if(external, 'external', 'shared-nav')", "if(is_price_discovery, 'leads the target', 'no lead')"]),
    "reversion": ("%s: b=%+.4f (se %.4f) adf_p=%.4f p(b=0)=%.3g -> %s: %s", ["ticker", "b", "b_se", "adf_p", "b_p", "resolution", "display"]),
    "alignment": ("%s: %d price rows, %d NAV rows, %d aligned, %d dropped (%d price only, %d NAV only, %d missing)", ["ticker", "n_price", "n_nav", "n_aligned", "n_dropped", "n_price_only", "n_nav_only", "n_dropped_na"]),
}


def as_rows(results: DataFrame, kind: str) -> DataFrame:
    """The columns of a report's rows, named and rounded (half to even) as reports have them."""
    return results.select(*((F.expr(c) if digits is None else F.bround(F.expr(c), digits)).alias(name) for name, c, digits in ROWS[kind]))


def as_lines(results: DataFrame, kind: str) -> DataFrame:
    """(ticker, line): one line of text a key, for consoles."""
    text, columns = LINES[kind]
    return results.select("ticker", F.format_string(text, *(F.expr(c) for c in columns)).alias("line"))


def flat(results: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded half to even, as report rows have them."""
    return results.select(*(F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes))


def write_csv(results: DataFrame, path: str) -> None:
    """One file with a header; a report has a row a key."""
    flat(results).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
