import math

import pytest
from pyspark.sql import functions as F

from tests.test_bootstrap_full import brute
from tidemark.operators.simulate import panel, simulate_ar1, simulate_ou
from tidemark.plans import queries, report


def test_report_guards_before_intervals(spark, monkeypatch):
    worlds = {"ECONOMY": simulate_ou(math.log(2) / 0.6, 150, seed=2), "LARGE": simulate_ou(math.log(2) / 3, 150, seed=3), "MEDIUM": simulate_ar1(0.0, 150, seed=4), "PROMO": simulate_ar1(1.0, 150, seed=1), "SMALL": simulate_ou(math.log(2) / 2, 150, seed=7)}
    rows = panel(spark, worlds).select("ticker", "date", (100 * (1 + F.col("x") / 10000)).alias("close"), F.lit(100.0).alias("nav"), F.lit(1e3).alias("volume"))
    rows = rows.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1}).cache()
    monkeypatch.setattr(queries, "smoothed", lambda s, d: rows)
    got = {r.ticker: r for r in queries.QUERIES["report_table"](spark, "").collect()}
    assert set(got) == set(worlds) and got["PROMO"].resolution == "unit_root" and got["MEDIUM"].resolution == "unresolved"
    for k in ("PROMO", "MEDIUM"):
        assert got[k].half_life is None and got[k].lower is None and got[k].n_valid is None
    want = {k: brute(k, worlds[k], 2000) for k in ("ECONOMY", "LARGE", "SMALL")}
    for k, (n, lower, upper) in want.items():
        assert got[k].resolution.startswith("identified") and got[k].n_valid == n
        assert (got[k].lower, got[k].upper) == pytest.approx((lower, upper), abs=1e-5)
    over = lambda a, b: want[a][1] <= want[b][2] and want[b][1] <= want[a][2]
    r = queries.QUERIES["report_separation"](spark, "").first()
    assert tuple(r)[:4] == (2, over("ECONOMY", "LARGE") + over("ECONOMY", "SMALL"), 1, int(over("LARGE", "SMALL")))
    table = queries._report(spark, "")
    for kind in ("quality", "liquidity", "intraday", "reversion", "results"):
        assert {x.ticker for x in report.as_rows(table.withColumn("median_range_bps", F.col("intraday_range_bps")) if kind == "liquidity" and "median_range_bps" not in table.columns else table, kind).collect()} == set(worlds)
    lines = {x.ticker: x.line for x in report.as_lines(table, "reversion").collect()}
    assert "-> unit_root: n/a (unit_root)" in lines["PROMO"] and "-> identified" in lines["LARGE"]
