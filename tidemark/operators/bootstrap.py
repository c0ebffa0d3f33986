"""Stationary block bootstrap of the half-life without a Python loop.

Random numbers are hashes of (tag, seed, key, replicate, position), so replicates do not depend on
partitioning.  Pairs of consecutive values are resampled, never values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clean

from .reversion import half_life, pairs

#: Pairs up to which a panel is sent to all tasks.
FEW = 500_000


def hashed(tag: str, seed: int, *parts: Column) -> Column:
    """A 32-bit integer from the md5 of the parts."""
    text = F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stationary_indices(sizes: DataFrame, n_boot: int, seed: int = 0, block: float | None = None) -> DataFrame:
    """(ticker, rep, i, idx): per key with m pairs, n_boot replicates of m indices in wrapped geometric blocks.

    Replicates are dealt out before their positions are made, and only first positions of blocks are sorted.
    """
    length = F.greatest(F.lit(2.0), F.pow((F.col("m") + 1).cast("double"), F.lit(1 / 3))) if block is None else F.lit(float(block))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).repartition(parts, "ticker", "rep")
    grid = reps.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)))
    new = (F.col("i") == 0) | (hashed("n", seed, F.col("ticker"), F.col("rep"), F.col("i") - 1) / 4294967296.0 < 1 / length)
    w = Window.partitionBy("ticker", "rep").orderBy("i")
    blocks = grid.where(new).withColumns({"blk": F.row_number().over(w), "end": F.coalesce(F.lead("i").over(w), F.col("m"))})
    blocks = blocks.withColumn("start", hashed("s", seed, F.col("ticker"), F.col("rep"), F.col("blk")) % F.col("m"))
    rows = blocks.withColumn("off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("i") - 1)))
    return rows.select("ticker", "rep", (F.col("i") + F.col("off")).alias("i"), ((F.col("start") + F.col("off")) % F.col("m")).alias("idx"))


def fitted_half_life(x: Column, y: Column) -> Column:
    """An aggregate: the half-life of the slope of y on x."""
    return half_life(F.regr_slope(y, x))


def bootstrap_interval(df: DataFrame, value: str = "x", n_boot: int = 2000, level: float = 0.95, block: float | None = None, seed: int = 0, least: int = 20, statistic: Callable[[Column, Column], Column] = fitted_half_life) -> DataFrame:
    """Per key: lower, upper, n_valid of a statistic of pairs; undefined if fewer than half of the replicates have a finite value.

    ``statistic`` makes an aggregate of the columns of a replicate's pairs (value before, value).
    """
    p = pairs(df, value).withColumn("idx", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).cast("long")).persist()  # read by three branches
    sizes = p.groupBy("ticker").agg(F.count("*").alias("m")).where(F.col("m") + 1 >= least)
    drawable = p.select("ticker", "idx", "x", "y")
    drawable = F.broadcast(drawable) if p.count() <= FEW else drawable  # n_boot times as many positions stay where they are
    drawn = stationary_indices(sizes, n_boot, seed, block).join(drawable, ["ticker", "idx"])
    reps = drawn.groupBy("ticker", "rep").agg(clean(statistic(F.col("x"), F.col("y")).cast("double")).alias("h"))
    out = reps.groupBy("ticker").agg(F.count("h").alias("n_valid"), F.percentile("h", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    ok = F.col("n_valid") >= 0.5 * n_boot
    return out.select("ticker", "n_valid", F.when(ok, F.col("q")[0]).alias("lower"), F.when(ok, F.col("q")[1]).alias("upper"))
