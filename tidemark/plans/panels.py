"""Panels derived from the relational tables: one row per key and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types by ship date: unit price against discounted unit price."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg(unit).alias("close"),
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("nav"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum("l_quantity").cast("double").alias("volume"),
    )


def segment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments by order date: mean order price."""
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def segment_navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments by ship date: a published value with its own calendar."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg((F.avg("l_extendedprice") * 5).alias("nav"))


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by hour: open, high, low, close, mean value."""
    rows = _table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.avg("value").alias("nav"), F.count("*").cast("double").alias("volume")
    )


#: (ticker, sleeve, band in bps, foreign session, role) of the derived panels' keys; fixed values.
UNIVERSE = [
    ("ECONOMY", "equity_us_large", 900.0, False, "primary"),
    ("LARGE", "credit_hy", 950.0, True, "primary"),
    ("MEDIUM", "debt_em", 1000.0, True, "primary"),
    ("PROMO", "equity_em", 1050.0, True, "primary"),
    ("SMALL", "credit_ig", 1000.0, False, "primary"),
    ("STANDARD", "equity_us_total", 900.0, False, "control"),
]


def universe(spark: SparkSession) -> DataFrame:
    """The key dimension; its size is the number of keys and it is small by construction."""
    return spark.createDataFrame(UNIVERSE, "ticker string, sleeve string, band_bps double, foreign_session boolean, role string")
