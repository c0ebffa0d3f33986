"""Queries over the derived panels.  Doubles are rounded, and a negative zero made positive, for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import align, bootstrap, cross_section, discovery, flags, intraday, liquidity, reversion, variance_ratio
from tidemark.operators.flags import by_date
from tidemark.operators.premium import add_premium, describe_premium
from tidemark.sources.nav_files import sniff_format

from . import panels, report

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def types(spark: SparkSession, d: str) -> DataFrame:
    return add_premium(panels.type_daily(spark, d))


def segments(spark: SparkSession, d: str) -> tuple:
    return panels.segment_prices(spark, d), panels.segment_navs(spark, d)


def series(spark: SparkSession, d: str, kind: str | None = "ma5") -> DataFrame:
    """Derived series (ticker, date, x) with different persistence, rounded before use; None: all of them, in one pass."""
    x = F.col("premium_bps")
    rows = types(spark, d).select("ticker", "date", "premium_bps")
    mean = lambda k: F.when(F.count("*").over(by_date().rowsBetween(1 - k, 0)) == k, F.avg(x).over(by_date().rowsBetween(1 - k, 0)))
    values = {"raw": x, "ma5": mean(5), "ma20": mean(20), "mix": x + 0.3 * F.lag(x).over(by_date()), "diff": x - F.lag(x).over(by_date())}
    if kind is not None:
        return rows.select("ticker", "date", F.round(values[kind], 6).alias("x")).where("x IS NOT NULL")
    made = rows.select("ticker", "date", *(F.round(v, 6).alias(k) for k, v in values.items()))
    long = made.unpivot(["ticker", "date"], list(values), "kind", "x").where("x IS NOT NULL")
    return long.select(F.concat_ws("/", "ticker", "kind").alias("ticker"), "date", "x")


@query
def premium_series(spark, d):
    return rounded(types(spark, d).select("ticker", "date", "close", "nav", "premium", "premium_bps"))


@query
def premium_custom_cols(spark, d):
    p = panels.type_daily(spark, d).withColumnsRenamed({"high": "px", "low": "ref"}).select("ticker", "date", "px", "ref")
    return rounded(add_premium(p, "px", "ref").select("ticker", "date", "premium_bps"))


@query
def premium_describe(spark, d):
    return rounded(describe_premium(types(spark, d), p_value=False))


@query
def align_inner(spark, d):
    return rounded(align.align_price_nav(*segments(spark, d)))


@query
def align_report(spark, d):
    return align.alignment_report(align.alignment_rows(*segments(spark, d)))


@query
def align_price_only(spark, d):
    return align.price_only(align.alignment_rows(*segments(spark, d)))


@query
def align_nav_only(spark, d):
    return align.nav_only(align.alignment_rows(*segments(spark, d)))


@query
def align_window(spark, d):
    return align.alignment_report(align.alignment_rows(*segments(spark, d), "1996-01-01", "1997-06-30"))


def flagged(spark, d):
    rows = types(spark, d).join(F.broadcast(panels.universe(spark).select("ticker", "band_bps")), "ticker")
    return flags.add_quality_flags(rows, nav_move_bps=50.0)


@query
def quality_flags(spark, d):
    return flagged(spark, d).select("ticker", "date", "nav_unchanged", "stale_nav", "extreme_premium")


@query
def quality_report(spark, d):
    return rounded(flags.quality_report(flagged(spark, d)))


@query
def quality_longest_run(spark, d):
    return flags.longest_run(flagged(spark, d))


@query
def quality_top5(spark, d):
    return rounded(flags.largest(types(spark, d)).select("ticker", "date", "premium_bps", "rank"))


@query
def intraday_bounds(spark, d):
    rows = intraday.add_intraday_premium(types(spark, d))
    return rounded(rows.select("ticker", "date", "premium_high_bps", "premium_low_bps", "premium_range_bps"))


@query
def intraday_profile(spark, d):
    return rounded(intraday.profile_intraday(intraday.add_intraday_premium(types(spark, d))))


@query
def liquidity_profile(spark, d):
    return rounded(liquidity.profile_liquidity(panels.type_daily(spark, d), digits=12), 4)


def _spread(spark, d, **more):
    return rounded(panels.type_daily(spark, d).select("ticker", "date", liquidity.high_low_spread(**more).alias("spread")))


@query
def cs_spread_raw(spark, d):
    return _spread(spark, d)


@query
def cs_spread_adjusted(spark, d):
    return _spread(spark, d, close="close")


@query
def cs_spread_clipped(spark, d):
    return _spread(spark, d, close="close", clip=True)


@query
def ar1_fit_hc1(spark, d):
    return rounded(reversion.fit_ar1(series(spark, d), p_value=False).drop("status"))


@query
def half_life(spark, d):
    fit = reversion.fit_ar1(series(spark, d), p_value=False)
    return rounded(fit.select("ticker", reversion.half_life(F.col("b")).alias("half_life"), reversion.half_life_to_kappa(reversion.half_life(F.col("b"))).alias("kappa")))


@query
def delta_interval(spark, d):
    fit = reversion.fit_ar1(series(spark, d), p_value=False)
    return rounded(fit.select("ticker", reversion.delta_interval(F.col("b"), F.col("b_se")).alias("i")).select("ticker", "i.lower", "i.upper"))


@query
def long_run(spark, d):
    fit = reversion.fit_ar1(series(spark, d, "ma20"), p_value=False)
    return rounded(fit.select("ticker", reversion.long_run(F.col("a"), F.col("b")).alias("level")))


@query
def variance_ratios(spark, d):
    return rounded(variance_ratio.variance_ratios(series(spark, d, "raw"), p_value=False))


@query
def variance_ratio_profile(spark, d):
    return variance_ratio.profile(variance_ratio.variance_ratios(series(spark, d, "raw"), p_value=False))


def _hours(spark, d):
    return add_premium(panels.event_hourly(spark, d))


def _target(spark, d):
    return panels.event_hourly(spark, d).select("ticker", "date", F.col("nav").alias("level"))


@query
def discovery_lead(spark, d):
    rows = discovery.premium_with_target(_hours(spark, d), _target(spark, d)).dropna(subset=["premium_bps", "lead_bps"])
    return rounded(discovery.regress(rows, "lead_bps", "premium_bps"))


@query
def discovery_placebo(spark, d):
    rows = discovery.premium_with_target(_hours(spark, d), _target(spark, d)).dropna(subset=["premium_bps", "lag_bps"])
    return rounded(discovery.regress(rows, "lag_bps", "premium_bps"))


@query
def discovery_verdict(spark, d):
    return rounded(discovery.measure_price_discovery(_hours(spark, d), _target(spark, d)).drop("external"))


@query
def gap_session_split(spark, d):
    return rounded(discovery.gap_share(_hours(spark, d), panels.event_hourly(spark, d)))


@query
def same_next_day(spark, d):
    rows = discovery.premium_with_target(_hours(spark, d), _target(spark, d)).dropna(subset=["premium_bps", "same_bps", "lead_bps"])
    same = discovery.regress(rows, "same_bps", "premium_bps").select("ticker", F.col("slope").alias("same_slope"), F.col("r2").alias("same_r2"))
    return rounded(same.join(discovery.regress(rows, "lead_bps", "premium_bps").select("ticker", F.col("slope").alias("next_slope"), F.col("r2").alias("next_r2")), "ticker"))


@query
def bootstrap_indices(spark, d):
    sizes = spark.createDataFrame([("A", 60), ("B", 37)], "ticker string, m long")
    return bootstrap.stationary_indices(sizes, 20, seed=3, block=6.0)


@query
def bootstrap_interval(spark, d):
    """A variant with 40 replicates, for its SQL; bootstrap_interval_full does the whole job."""
    return rounded(bootstrap.bootstrap_interval(series(spark, d), n_boot=40))


@query
def bootstrap_interval_full(spark, d):
    return rounded(bootstrap.bootstrap_interval(series(spark, d)))


@query
def adf_test(spark, d):
    return rounded(reversion.adf_test(series(spark, d)))


@query
def resolution(spark, d):
    return rounded(reversion.estimate_reversion(series(spark, d, None)).select("ticker", "a", "b", "b_se", "adf_p", "p_value", "resolution", "half_life", "bound", "display", "n"))


def _results(spark, d):
    """One row a key: delta intervals, half-life, sleeve and intraday range."""
    fit = reversion.fit_ar1(series(spark, d), p_value=False)
    i = reversion.delta_interval(F.col("b"), F.col("b_se"))
    rows = fit.select("ticker", reversion.half_life(F.col("b")).alias("half_life"), i["lower"].alias("lower"), i["upper"].alias("upper"))
    ranges = intraday.profile_intraday(intraday.add_intraday_premium(types(spark, d))).select("ticker", "median_range_bps")
    return rows.join(ranges, "ticker").join(F.broadcast(panels.universe(spark)), "ticker")


@query
def cross_section_table(spark, d):
    rows = cross_section.results_table(_results(spark, d).withColumn("asset_group", cross_section.asset_group(F.col("sleeve"))))
    return rounded(rows.select("ticker", "sleeve", "asset_group", "role", "half_life", "lower", "upper", "median_range_bps"))


@query
def separation_pairs(spark, d):
    return cross_section.interval_pairs(_results(spark, d))


@query
def separation_counts(spark, d):
    return cross_section.separation(cross_section.interval_pairs(_results(spark, d)))


@query
def overlap_matrix(spark, d):
    return cross_section.overlap_matrix(_results(spark, d))


def smoothed(spark, d):
    """The daily panel with prices whose deviation is the ma5 series; high and low still hold the price."""
    rows = types(spark, d).join(series(spark, d), ["ticker", "date"]).withColumn("close", F.col("nav") * (1 + F.col("x") / 10000))
    return rows.select("ticker", "date", "close", "nav", F.greatest("high", "close").alias("high"), F.least("low", "close").alias("low"), "volume")


def _report(spark, d):
    rows = smoothed(spark, d)
    return report.analyse(rows.drop("nav"), rows.select("ticker", "date", "nav"), panels.universe(spark).withColumnRenamed("band_bps", "outlier_band_bps"))


@query
def report_table(spark, d):
    return rounded(_report(spark, d))


@query
def report_separation(spark, d):
    """Pairs among keys with an estimate, on bootstrap intervals."""
    return cross_section.verdict(cross_section.separation(cross_section.interval_pairs(_report(spark, d))))


@query
def plot_order(spark, d):
    rows = _results(spark, d).withColumn("half_life", F.when(F.col("role") == "primary", F.col("half_life")))
    rows = rows.withColumn("display", F.when(F.col("half_life").isNull(), F.lit("< 0.75 d")).otherwise("-"))
    return rounded(cross_section.plot_order(rows).select("ticker", "has_estimate", "half_life", "bound", "median_range_bps"))


@query
def yearly_premium(spark, d):
    return rounded(cross_section.yearly(types(spark, d)))


@query
def exdiv_split(spark, d):
    rows = types(spark, d)
    return rounded(cross_section.event_split(rows, rows.where(F.dayofmonth("date") == 1)))


@query
def premium_histogram(spark, d):
    return cross_section.histogram(types(spark, d).withColumn("premium_bps", F.round("premium_bps", 4)))


@query
def extreme_dates(spark, d):
    return cross_section.extremes(types(spark, d).withColumn("premium_bps", F.round("premium_bps", 4)))


@query
def large_dev_share(spark, d):
    return rounded(cross_section.large_share(types(spark, d), 500.0))


#: What the cleaning queries are shown.
NUMBERS = ["$1,080.55", "(1.23)", "--", "", "N/A", " 7 ", "-4", "abc", "1e3"]
HEADERS = [' "NAV  per Share" ', "As Of", "'Close'", "net   asset value"]
DATES = ["2024-03-05", "Mar 5, 2024", "3/5/2024", "5-Mar-2024", "20240305", "soon", ""]


def _literals(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, raw string")


@query
def clean_numeric(spark, d):
    return _literals(spark, NUMBERS).select("i", T.number(F.col("raw")).alias("value"))


@query
def normalise_header(spark, d):
    return _literals(spark, HEADERS).select("i", T.header(F.col("raw")).alias("header"))


@query
def parse_dates(spark, d):
    return _literals(spark, DATES).select("i", T.mixed_date(F.col("raw")).alias("date"))


#: First characters of files.
FILES = ["PK\x03\x04rest", "﻿ <?xml version='1.0'?>", "<Workbook>", "<!DOCTYPE html><html>", "<table>", "Date,NAV\n", " <html>"]


@query
def nav_sniff(spark, d):
    return _literals(spark, FILES).select("i", sniff_format(F.encode("raw", "utf-8")).alias("format"))
