"""All keys at once: the result table, which keys can be told apart, and descriptive splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reversion import overlaps

#: Sleeves that count as equity; every other sleeve is credit.  Fixed values.
EQUITY = ["equity_us_large", "equity_us_total", "equity_intl_developed", "equity_em"]


def asset_group(sleeve: Column) -> Column:
    return F.when(sleeve.isin(*EQUITY), "equity").otherwise("credit")


def results_table(results: DataFrame) -> DataFrame:
    """Sorted by half-life, keys without one last."""
    return results.orderBy(F.asc_nulls_last("half_life"), "ticker")


def interval_pairs(results: DataFrame) -> DataFrame:
    """Each unordered pair of keys with an estimate and whether the intervals overlap; ``results``: one row a key, so few rows.

    Takes (ticker, sleeve, half_life, n_valid or none, lower, upper); a key has an estimate if it has a half-life.  An
    interval without bounds overlaps everything.  Keys are a dimension: the pairs are its square by definition.
    """
    results = results.where("half_life IS NOT NULL")
    side = lambda s: results.select(*(F.col(c).alias(f"{c}_{s}") for c in ("ticker", "sleeve", "lower", "upper")))
    both = side("a").join(side("b"), F.col("ticker_a") < F.col("ticker_b"))
    return both.select("ticker_a", "ticker_b", asset_group(F.col("sleeve_a")).alias("group_a"), asset_group(F.col("sleeve_b")).alias("group_b"), overlaps(F.col("lower_a"), F.col("upper_a"), F.col("lower_b"), F.col("upper_b")).alias("overlap"))


def overlap_matrix(results: DataFrame) -> DataFrame:
    """The symmetric matrix of keys with an estimate as rows (a, b, overlap), true diagonal included."""
    ab = interval_pairs(results).select(F.col("ticker_a").alias("a"), F.col("ticker_b").alias("b"), "overlap")
    ba = ab.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap")
    same = results.where("half_life IS NOT NULL").select(F.col("ticker").alias("a"), F.col("ticker").alias("b"), F.lit(True).alias("overlap"))
    return ab.union(ba).union(same)


def separation(pairs: DataFrame) -> DataFrame:
    """One row: pairs and overlaps across groups and within credit."""
    cross = F.col("group_a") != F.col("group_b")
    credit = (F.col("group_a") == "credit") & (F.col("group_b") == "credit")
    return pairs.agg(F.count_if(cross).alias("cross_pairs"), F.count_if(cross & F.col("overlap")).alias("cross_overlaps"), F.count_if(credit).alias("credit_pairs"), F.count_if(credit & F.col("overlap")).alias("credit_overlaps"))


def verdict(counts: DataFrame) -> DataFrame:
    """The counts with groups_separate, within_credit_resolved and a line of text."""
    line = F.format_string("equity-vs-credit overlapping: %d/%d; credit-vs-credit overlapping: %d/%d", "cross_overlaps", "cross_pairs", "credit_overlaps", "credit_pairs")
    return counts.withColumns({"groups_separate": F.col("cross_overlaps") == 0, "within_credit_resolved": F.col("credit_overlaps") == 0, "summary": line})


def plot_order(results: DataFrame) -> DataFrame:
    """Chart rows: keys with an estimate by half-life descending, then the others by intraday range descending, with the bound."""
    has = F.col("half_life").isNotNull()
    bound = F.regexp_extract("display", r"<\s*([0-9.]+)\s*d", 1)
    rows = results.withColumns({"has_estimate": has, "bound": F.when(bound != "", bound.cast("double")).otherwise(1.0)})
    return rows.orderBy(F.desc("has_estimate"), F.when(has, F.col("half_life")).desc_nulls_last(), F.when(~has, F.col("median_range_bps")).desc_nulls_last(), "ticker")


def yearly(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker", F.year("date").alias("year")).agg(F.avg("premium_bps").alias("mean_bps"), F.count("premium_bps").alias("n"))


def event_split(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Means on and off event dates ((ticker, date) rows), and their difference."""
    marked = df.join(dates.select("ticker", "date").distinct().withColumn("is_event", F.lit(True)), ["ticker", "date"], "left")
    on = F.col("is_event").isNotNull()
    x = F.col("premium_bps")
    out = marked.groupBy("ticker").agg(F.avg(F.when(on, x)).alias("mean_on"), F.count(F.when(on, x)).alias("n_on"), F.avg(F.when(~on, x)).alias("mean_off"), F.count(F.when(~on, x)).alias("n_off"))
    return out.withColumn("difference", F.col("mean_on") - F.col("mean_off"))


def histogram(df: DataFrame, bins: int = 90) -> DataFrame:
    """(ticker, bin, n): equal widths between each key's extremes; the maximum is in the last bin."""
    ends = df.groupBy("ticker").agg(F.min("premium_bps").alias("lo"), F.max("premium_bps").alias("hi"))
    place = F.floor(F.try_divide((F.col("premium_bps") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    rows = df.where("premium_bps IS NOT NULL").join(ends, "ticker")
    return rows.groupBy("ticker", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame) -> DataFrame:
    """Per key: dates of the largest and the smallest deviation (the earliest of ties)."""
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    return df.groupBy("ticker").agg(F.max_by("date", F.struct("premium_bps", -day)).alias("max_date"), F.min_by("date", F.struct("premium_bps", day)).alias("min_date"))


def large_share(df: DataFrame, bps: float = 100.0) -> DataFrame:
    return df.groupBy("ticker").agg((F.avg((F.abs("premium_bps") > bps).cast("double")) * 100).alias("pct_large"))


def adjusted_drift(df: DataFrame) -> DataFrame:
    """(ticker, date, drift_bps): how far the traded close lies above the adjusted one."""
    return df.select("ticker", "date", ((F.try_divide("close", "adj_close") - 1) * 10_000).alias("drift_bps"))


def decay_curve(fits: DataFrame, last: float = 6.0, points: int = 200) -> DataFrame:
    """(ticker, day, percent): what is left of a deviation, 100 b^t, at evenly spaced times; ``fits``: (ticker, b)."""
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(last / (points - 1)))).alias("day")
    return fits.select("ticker", "b", day).select("ticker", "day", (100 * F.pow("b", "day")).alias("percent"))


def sides(df: DataFrame) -> DataFrame:
    """(ticker, date, premium, discount): the deviation where it is not negative, and where it is."""
    x = F.col("premium_bps")
    return df.select("ticker", "date", F.when(x >= 0, x).alias("premium"), F.when(x < 0, x).alias("discount"))


def trough(df: DataFrame, start: str, end: str) -> DataFrame:
    """Per key: date and value of the lowest deviation within inclusive dates (the earliest of ties)."""
    rows = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("premium_bps").isNotNull())
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    return rows.groupBy("ticker").agg(F.min_by("date", F.struct("premium_bps", day)).alias("date"), F.min("premium_bps").alias("premium_bps"))
