"""Strict alignment of prices and published values: inner join on key and date, nothing filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_filter(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates within inclusive bounds, each optional."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def align_price_nav(prices: DataFrame, navs: DataFrame, start: str | None = None, end: str | None = None, check: bool = True) -> DataFrame:
    """Rows whose key and date are on both sides, without rows whose close or nav is missing.

    ``check`` refuses keys with an empty side or without a common date, by one aggregate beforehand.
    """
    if check:
        check_aligned(alignment_report(alignment_rows(prices, navs, start, end)))
    both = window_filter(prices, start, end).join(window_filter(navs, start, end), ["ticker", "date"])
    return both.dropna(subset=["close", "nav"])


def alignment_rows(prices: DataFrame, navs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One full outer join that marks where each date comes from."""
    p = window_filter(prices, start, end).withColumn("in_price", F.lit(True))
    n = window_filter(navs, start, end).withColumn("in_nav", F.lit(True))
    return p.join(n, ["ticker", "date"], "full_outer")


def price_only(rows: DataFrame) -> DataFrame:
    return rows.where("in_nav IS NULL").select("ticker", "date")


def nav_only(rows: DataFrame) -> DataFrame:
    return rows.where("in_price IS NULL").select("ticker", "date")


def alignment_report(rows: DataFrame, dates: bool = False) -> DataFrame:
    """Per key: counts of both sides, of aligned rows and of what was dropped (and the dates)."""
    both = F.col("in_price").isNotNull() & F.col("in_nav").isNotNull()
    whole = F.col("close").isNotNull() & F.col("nav").isNotNull()
    aggs = [
        F.count("in_price").alias("n_price"),
        F.count("in_nav").alias("n_nav"),
        F.count_if(both & whole).alias("n_aligned"),
        F.count_if(both & ~whole).alias("n_dropped_na"),
        F.count_if(F.col("in_nav").isNull()).alias("n_price_only"),
        F.count_if(F.col("in_price").isNull()).alias("n_nav_only"),
    ]
    if dates:
        aggs += [F.array_sort(F.collect_list(F.when(F.col("in_nav").isNull(), F.col("date")))).alias("price_only"), F.array_sort(F.collect_list(F.when(F.col("in_price").isNull(), F.col("date")))).alias("nav_only")]
    out = rows.groupBy("ticker").agg(*aggs)
    return out.withColumn("n_dropped", F.col("n_price_only") + F.col("n_nav_only") + F.col("n_dropped_na"))


def check_aligned(report: DataFrame) -> None:
    """Refuses keys with an empty side or without a common date, and a report without keys."""
    common = F.col("n_aligned") + F.col("n_dropped_na")
    r = report.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.when((F.col("n_price") == 0) | (F.col("n_nav") == 0) | (common == 0), F.col("ticker")))), 1, 5).alias("bad")).first()
    if not r.n or r.bad:
        raise ValueError(f"prices and published values share no dates: {', '.join(map(str, r.bad)) or 'no rows at all'}")
