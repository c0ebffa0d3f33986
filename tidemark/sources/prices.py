"""Price tables: normalised columns, guards, and a partitioned Parquet store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import clean

REQUIRED = ["open", "high", "low", "close", "adj_close", "volume"]
#: Vendor column names and ours; fixed values.
RENAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume", "Date": "date"}


class PriceDataError(ValueError):
    """Prices that must not be used; says why."""


def normalise(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Our column names, local dates, doubles without NaN; a nested table of one key is flattened."""
    nested = [f.name for f in raw.schema if f.dataType.typeName() == "struct"]
    if ticker is not None and nested:
        if ticker not in nested:
            raise PriceDataError(f"{ticker}: not present")
        raw = raw.select(*(c for c in raw.columns if c not in nested), f"`{ticker}`.*")
    cols = {RENAMES.get(c, c): c for c in raw.columns}
    if missing := [c for c in ["date", *REQUIRED] if c not in cols]:
        hint = "; adjusted prices must not stand for traded ones" if "adj_close" in missing else ""
        raise PriceDataError(f"missing columns: {', '.join(missing)}{hint}")
    key = F.lit(ticker) if ticker is not None else F.col("ticker")
    return raw.select(key.alias("ticker"), F.to_date(F.col(f"`{cols['date']}`")).alias("date"), *(clean(F.col(f"`{cols[c]}`").cast("double")).alias(c) for c in REQUIRED))


def check_prices(df: DataFrame, least: int = 250) -> DataFrame:
    """The same rows; refuses keys that fail a guard (one aggregate over all keys)."""
    both = F.col("close").isNotNull() & F.col("adj_close").isNotNull()
    report = df.groupBy("ticker").agg(
        F.count("close").alias("closes"), F.count_if(F.col("close") <= 0).alias("not_positive"), (F.count("date") - F.count_distinct("date")).alias("twice"),
        F.count_if(both).alias("both"), F.coalesce(F.bool_and(F.when(both, F.col("close") == F.col("adj_close"))), F.lit(False)).alias("equal"),
    )
    problem = (
        F.when(F.col("closes") == 0, "no close at all")
        .when(F.col("not_positive") > 0, "closes that are not positive")
        .when(F.col("twice") > 0, "duplicate dates")
        .when((F.col("both") > least) & F.col("equal"), "close equals adj_close throughout: adjusted prices")
    )
    rows = report.withColumn("problem", problem).groupBy().agg(F.count("*").alias("n"), F.slice(F.collect_list(F.when(F.col("problem").isNotNull(), F.concat_ws(": ", "ticker", "problem"))), 1, 5).alias("bad")).first()
    if not rows.n:
        raise PriceDataError("no rows")
    if rows.bad:
        raise PriceDataError("; ".join(rows.bad))
    return df


def write_prices(df: DataFrame, path: str) -> None:
    """Parquet partitioned by key, so a scan of some keys reads only their folders."""
    df.write.mode("overwrite").partitionBy("ticker").parquet(path)


def read_prices(spark: SparkSession, path: str, start=None, end=None, tickers: list | None = None) -> DataFrame:
    """Inclusive date bounds and keys are pushed down to the scan.

    Unlike a cache that counts as hit when any row lies in the window, this returns what is
    stored; whether that covers the window is the caller's question.
    """
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df if tickers is None else df.where(F.col("ticker").isin(*tickers))
