"""Distribution functions that Spark lacks, and finite-value helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def finite(c) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clean(c) -> Column:
    """NaN and infinities become null, the only missing value inside the engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), c)


def z_value(level: float) -> float:
    """Two-sided normal quantile, e.g. 1.96 for 0.95."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's distribution."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def norm_two_sided(z: float) -> float:
    """P(|Z| > |z|) of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Few rows: one a key; Spark has no error function."""
    return pd.Series([None if pd.isna(a) else norm_two_sided(a) for a in z], dtype="float64")
