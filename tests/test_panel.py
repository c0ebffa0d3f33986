import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_two_sided, t_two_sided
from tidemark.operators import align, bootstrap, cross_section, discovery, flags, intraday, liquidity, reversion, variance_ratio
from tidemark.operators.premium import add_premium, describe_premium
from tidemark.operators.simulate import panel, simulate_ar1, simulate_ou

DAY = date(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame([("A", DAY + timedelta(i), *r) for i, r in enumerate(rows)], f"ticker string, date date, {schema}")


def test_distributions():
    assert abs(t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(norm_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(t_two_sided(0.5, 3) - 0.6514) < 1e-3


def test_premium_and_description(spark):
    df = frame(spark, [(101.0, 100.0), (99.0, 100.0), (None, 100.0), (100.0, 100.0)], "close double, nav double")
    out = describe_premium(add_premium(df)).first()
    assert (out.n, round(out.mean_bps, 6), out.min_bps, round(out.frac_positive, 6)) == (3, 0.0, pytest.approx(-100), 0.333333)
    for bad in (0.0, None, math.nan):
        with pytest.raises(Exception, match="not positive"):
            add_premium(df.withColumn("nav", F.lit(bad).cast("double"))).collect()
    assert add_premium(df.withColumn("nav", F.lit(0.0)), strict=False).where("premium IS NULL").count() == 4
    with pytest.raises(ValueError):
        add_premium(df, "px")


def test_alignment_never_fills(spark):
    px = frame(spark, [(1.0,), (2.0,), (None,), (4.0,)], "close double")
    nav = px.select("ticker", F.date_add("date", 1).alias("date"), F.lit(3.0).alias("nav"))
    rows = align.align_price_nav(px, nav).collect()
    assert sorted(r.date for r in rows) == [DAY + timedelta(1), DAY + timedelta(3)]
    r = align.alignment_report(align.alignment_rows(px, nav), dates=True).first()
    assert (r.n_price, r.n_nav, r.n_aligned, r.n_dropped_na, r.price_only, r.nav_only) == (4, 4, 2, 1, [DAY], [DAY + timedelta(4)])
    with pytest.raises(ValueError):
        align.align_price_nav(px, nav.limit(0))
    with pytest.raises(ValueError, match="no rows"):
        align.align_price_nav(px.limit(0), nav.limit(0))
    with pytest.raises(ValueError, match="A"):
        align.align_price_nav(px, nav, end="2024-01-01")


def test_flags_keep_rows(spark):
    df = frame(spark, [(100.0, 100.0), (101.0, 100.0), (101.0, 100.0), (101.1, 100.0), (103.0, 100.5)], "close double, nav double")
    f = flags.add_quality_flags(add_premium(df), band_bps=200.0)
    got = [tuple(r) for r in f.orderBy("date").select("nav_unchanged", "stale_nav", "extreme_premium").collect()]
    assert got == [(False, False, False), (True, True, False), (True, False, False), (True, False, False), (False, False, True)]
    r = flags.quality_report(f).first()
    assert (r.n_obs, r.n_stale, r.n_extreme, r.longest_run, r.pct_stale) == (5, 1, 1, 3, 20.0)
    with pytest.raises(ValueError):
        flags.add_quality_flags(add_premium(df), band_bps=0)


def test_intraday(spark):
    df = frame(spark, [(100.0, 102.0, 99.0, 100.0), (101.0, 101.0, 100.5, 100.0)], "close double, high double, low double, nav double")
    r = intraday.profile_intraday(intraday.add_intraday_premium(add_premium(df))).first()
    assert r.pct_straddle == 50.0 and abs(r.median_range_bps - 175) < 1e-6 and abs(r.median_unwound_bps - 100) < 1e-6
    flat = frame(spark, [(100.0, 101.0, 99.0, 100.0)], "close double, high double, low double, nav double")
    assert intraday.profile_intraday(intraday.add_intraday_premium(add_premium(flat))).first().range_to_close == math.inf


def test_ar1_against_matrix_form(spark):
    x = simulate_ar1(0.6, 400, seed=3)
    r = reversion.fit_ar1(panel(spark, {"A": x})).first()
    z = np.column_stack([np.ones(399), x[:-1]])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ x[1:]
    e = x[1:] - z @ beta
    se = math.sqrt((inv @ (z.T * e**2) @ z @ inv)[1, 1] * 399 / 397)
    assert abs(r.b - beta[1]) < 1e-10 and abs(r.b_se - se) < 1e-10 and r.n == 399
    assert reversion.fit_ar1(panel(spark, {"A": x[:2]})).first().b is None


def test_half_life_is_recovered(spark):
    x = simulate_ou(math.log(2) / 3, 20_000, seed=1)
    fit = reversion.fit_ar1(panel(spark, {"A": x}), p_value=False).select(reversion.half_life(F.col("b")).alias("h")).first()
    assert abs(fit.h - 3.0) < 0.2


def test_resolution_labels(spark):
    worlds = {"walk": simulate_ar1(1.0, 2185, seed=1), "slow": simulate_ou(math.log(2) / 3, 2185, seed=2), "sub": simulate_ou(math.log(2) / 0.5, 2185, seed=3), "noise": simulate_ar1(0.0, 2185, seed=4), "swing": simulate_ar1(-0.4, 2185, seed=5), "tiny": np.arange(5.0)}
    got = {r.ticker: r for r in reversion.estimate_reversion(panel(spark, worlds)).collect()}
    assert {k: r.resolution for k, r in got.items()} == {"walk": "unit_root", "slow": "identified", "sub": "identified_subdaily", "noise": "unresolved", "swing": "oscillatory", "tiny": None}
    assert got["noise"].half_life is None and got["noise"].bound is not None and got["noise"].display.startswith("<")


def test_adf_critical_values():
    assert [round(reversion.mackinnon_p(t), 2) for t in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.10]
    assert reversion.mackinnon_p(3) == 1 and reversion.mackinnon_p(-20) == 0


def test_variance_ratio_closed_form(spark):
    b = 0.7
    out = variance_ratio.variance_ratios(panel(spark, {"A": simulate_ar1(b, 60_000, seed=7)}))
    for r in out.collect():
        assert abs(r.ratio / ((1 - b**r.horizon) / (r.horizon * (1 - b))) - 1) < 0.05
    p = variance_ratio.profile(out).first()
    assert p.all_below_one and p.monotone_decreasing and p.confirms_mean_reversion
    short = variance_ratio.variance_ratios(panel(spark, {"A": simulate_ar1(b, 60, seed=7)})).collect()
    assert {r.horizon: r.ratio is None for r in short} == {2: False, 5: False, 10: True, 20: True}


def test_bootstrap(spark):
    sizes = spark.createDataFrame([("A", 500)], "ticker string, m long")
    rows = bootstrap.stationary_indices(sizes, 30, seed=1, block=10.0).toPandas()
    assert rows.groupby("rep").size().eq(500).all() and rows.idx.between(0, 499).all()
    rows = rows.sort_values(["rep", "i"])
    steps = ((rows.idx.diff() % 500) != 1) & (rows.i > 0)
    assert 35 < steps.groupby(rows.rep).sum().mean() < 65
    x = simulate_ou(math.log(2) / 3, 1500, seed=9)
    r = bootstrap.bootstrap_interval(panel(spark, {"A": x}), n_boot=60).first()
    assert r.n_valid == 60 and r.lower < 3.0 < r.upper


def test_corwin_schultz_needs_two_days(spark):
    df = frame(spark, [(101.0, 99.0, 100.0), (101.0, 99.0, 100.0), (111.0, 109.0, 110.0)], "high double, low double, close double")
    got = df.select("date", liquidity.high_low_spread(close="close").alias("s")).orderBy("date").collect()
    h = math.log(101 / 99) ** 2
    k = 3 - 2 * math.sqrt(2)
    a = (math.sqrt(4 * h) - math.sqrt(2 * h)) / k - math.sqrt(h / k)
    assert got[0].s is None and abs(got[1].s - 2 * (math.exp(a) - 1) / (1 + math.exp(a))) < 1e-12
    for c, v in (("high", 1.0), ("low", -1.0)):
        with pytest.raises(Exception, match="impossible"):
            liquidity.profile_liquidity(df.withColumn(c, F.lit(v)).withColumn("volume", F.lit(1.0))).collect()


def test_discovery_shifts_on_the_targets_calendar(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.normal(0, 50, n)
    ret = np.r_[0, x[:-1]] * 0.8 + rng.normal(0, 20, n)
    level = 100 * np.cumprod(1 + ret / 1e4)
    days = [DAY + timedelta(i) for i in range(n)]
    p = spark.createDataFrame([("A", d, float(v)) for d, v in zip(days, x)], "ticker string, date date, premium_bps double")
    t = spark.createDataFrame([("A", d, float(v)) for d, v in zip(days, level)], "ticker string, date date, level double")
    r = discovery.measure_price_discovery(p, t).first()
    assert abs(r.slope - 0.8) < 0.05 and r.is_price_discovery and r.placebo_r2 < 0.02
    few = discovery.measure_price_discovery(p.limit(20), t).first()
    assert few.slope is None and not few.is_price_discovery


def test_cross_section(spark):
    schema = "ticker string, sleeve string, half_life double, lower double, upper double"
    rows = [("A", "equity_em", 0.15, 0.1, 0.2), ("B", "debt_em", 0.7, 0.5, 1.0), ("C", "credit_hy", 1.1, 0.9, 1.5), ("D", "debt_em", None, None, None)]
    some = spark.createDataFrame(rows, schema)
    assert tuple(cross_section.separation(cross_section.interval_pairs(some)).first()) == (2, 0, 1, 1)
    m = {(x.a, x.b): x.overlap for x in cross_section.overlap_matrix(some).collect()}
    assert len(m) == 9 and all(m[a, b] == m[b, a] for a, b in m) and m["A", "A"] and not m["A", "B"]
    assert cross_section.overlap_matrix(some.where("ticker = 'A'")).count() == 1
    wide = cross_section.interval_pairs(some.withColumn("half_life", F.lit(1.0)))  # an estimate, an interval without bounds
    assert tuple(cross_section.separation(wide).first()) == (3, 1, 3, 3)
    res = spark.createDataFrame([("A", None), ("B", 2.0), ("C", 1.0)], "ticker string, half_life double")
    assert [x.ticker for x in cross_section.results_table(res).collect()] == ["C", "B", "A"]


def test_published_intervals_separate(spark):
    """The five intervals that the published study reports: no equity interval meets a credit one, all credit ones meet."""
    rows = [("IVV", "equity_us_large", 0.21, 0.36), ("EEM", "equity_em", 0.22, 0.55), ("HYG", "credit_hy", 0.69, 1.15), ("EMB", "debt_em", 0.77, 1.94), ("LQD", "credit_ig", 0.82, 1.98)]
    df = spark.createDataFrame(rows, "ticker string, sleeve string, lower double, upper double").withColumn("half_life", (F.col("lower") + F.col("upper")) / 2)
    r = cross_section.verdict(cross_section.separation(cross_section.interval_pairs(df))).first()
    assert (r.cross_overlaps, r.cross_pairs, r.credit_overlaps, r.credit_pairs) == (0, 6, 3, 3)
    assert r.groups_separate and not r.within_credit_resolved and r.summary == "equity-vs-credit overlapping: 0/6; credit-vs-credit overlapping: 3/3"
    sleeves = ["equity_us_large", "equity_us_total", "equity_intl_developed", "credit_ig", "credit_hy", "debt_em", "equity_em"]
    got = spark.createDataFrame([(s,) for s in sleeves], "s string").select(cross_section.asset_group(F.col("s"))).collect()
    assert [g[0] for g in got] == ["equity"] * 3 + ["credit"] * 3 + ["equity"]
    touch = spark.createDataFrame([("A", "debt_em", 1.0, 0.5, 1.5), ("B", "debt_em", 2.0, 1.5, 2.5)], "ticker string, sleeve string, half_life double, lower double, upper double")
    assert cross_section.interval_pairs(touch).first().overlap


def test_simulators_follow_their_recursions():
    e = np.random.default_rng(3).standard_normal(50)
    for b in (0.9, 1.0, -0.4, 0.0, 1.01):
        x, want = simulate_ar1(b, 50, seed=3, a=0.5), [e[0] / math.sqrt(1 - b * b) if abs(b) < 1 else e[0]]
        for v in e[1:]:
            want.append(0.5 + b * want[-1] + v)
        assert np.allclose(x, want, rtol=1e-10)
    x = simulate_ou(0.5, 30, seed=2, sigma=0.0, mu=3.0, x0=5.0)
    assert np.allclose(x, 3 + 2 * np.exp(-0.5 * np.arange(30)))
    z = np.random.default_rng(2).standard_normal(4)
    y = simulate_ou(0.5, 4, seed=2)
    assert abs(y[0] - z[0]) < 1e-12 and abs(y[1] - (y[0] * math.exp(-0.5) + z[1] * math.sqrt(1 - math.exp(-1)))) < 1e-12
    for bad in (dict(kappa=0, n=5), dict(kappa=1, n=1), dict(kappa=1, n=5, sigma=-1), dict(kappa=1, n=5, dt=0)):
        with pytest.raises(ValueError):
            simulate_ou(**bad)
    with pytest.raises(ValueError):
        simulate_ar1(0.5, 1)


def test_intervals_and_statistics(spark):
    worlds = {"slow": simulate_ou(math.log(2) / 3, 600, seed=2), "noise": simulate_ar1(0.0, 600, seed=4)}
    got = {r.ticker: r for r in reversion.estimate_reversion(panel(spark, worlds), intervals=True, n_boot=40).collect()}
    s, n = got["slow"], got["noise"]
    assert s.lower < s.half_life < s.upper and s.delta_lower < s.half_life < s.delta_upper and s.n_valid == 40 and "reject" in s.reason
    assert n.lower is None and n.delta_lower is None and n.n_valid is None and n.display.startswith("< ") and "unresolved, fit" in n.display
    slope = bootstrap.bootstrap_interval(panel(spark, worlds), n_boot=40, statistic=lambda x, y: F.regr_slope(y, x))
    rows = {r.ticker: r for r in slope.collect()}
    assert rows["slow"].lower < s.b < rows["slow"].upper and rows["noise"].lower < 0 < rows["noise"].upper
    df = spark.createDataFrame([(0.1, 0.5), (None, 0.5)], "lo double, up double")
    lo, up = F.col("lo"), F.col("up")
    assert [tuple(r) for r in df.select(reversion.width(lo, up), reversion.is_defined(lo, up), reversion.contains(lo, up, F.lit(0.5)), reversion.show_interval(lo, up)).collect()] == [(0.4, True, True, "[0.10, 0.50]"), (None, False, False, "[undefined]")]


def test_small_projections(spark):
    df = frame(spark, [(110.0, 100.0, -3.0), (105.0, 105.0, 2.0), (99.0, 100.0, -3.0)], "close double, adj_close double, premium_bps double")
    assert [round(r.drift_bps) for r in cross_section.adjusted_drift(df).collect()] == [1000, 0, -100]
    assert [(r.premium, r.discount) for r in cross_section.sides(df).collect()] == [(None, -3.0), (2.0, None), (None, -3.0)]
    assert tuple(cross_section.trough(df, "2024-01-02", "2024-12-31").first()) == ("A", DAY + timedelta(2), -3.0)
    curve = cross_section.decay_curve(spark.createDataFrame([("A", 0.5)], "ticker string, b double"), 2.0, 3).collect()
    assert [(r.day, r.percent) for r in curve] == [(0.0, 100.0), (1.0, 50.0), (2.0, 25.0)]


def test_intraday_counts_missing_rows(spark):
    df = frame(spark, [(100.0, 102.0, 99.0, 100.0), (101.0, None, None, 100.0)], "close double, high double, low double, nav double")
    r = intraday.profile_intraday(intraday.add_intraday_premium(add_premium(df))).first()
    assert (r.n, r.pct_straddle) == (2, 50.0) and abs(r.median_range_bps - 300) < 1e-6


def test_nonrobust_errors(spark):
    x = simulate_ar1(0.6, 200, seed=3)
    r = reversion.fit_ar1(panel(spark, {"A": x}), cov_type="nonrobust").first()
    z = np.column_stack([np.ones(199), x[:-1]])
    beta, *_ = np.linalg.lstsq(z, x[1:], rcond=None)
    e = x[1:] - z @ beta
    se = math.sqrt(e @ e / 197 * np.linalg.inv(z.T @ z)[1, 1])
    assert abs(r.b_se - se) < 1e-10 and abs(r.p_value - t_two_sided(beta[1] / se, 197)) < 1e-9
    with pytest.raises(ValueError):
        reversion.fit_ar1(panel(spark, {"A": x}), cov_type="HC9")


def test_adf_statistic_against_normal_equations():
    """Statistic and lag choice by solving each regression's normal equations exactly (fractions)."""
    from fractions import Fraction

    x = [round(float(v), 3) for v in simulate_ar1(0.7, 40, seed=8)]
    d = [b - a for a, b in zip(x, x[1:])]
    most = math.ceil(12 * (40 / 100) ** 0.25)

    def solve(p, drop):
        rows = range(drop, len(d))
        z = [[Fraction(1), Fraction(x[t]), *(Fraction(d[t - i]) for i in range(1, p + 1))] for t in rows]
        y = [Fraction(d[t]) for t in rows]
        k = p + 2
        m = [[sum(r[i] * r[j] for r in z) for j in range(k)] + [sum(r[i] * v for r, v in zip(z, y))] + [Fraction(int(i == 1))] for i in range(k)]
        for i in range(k):
            m[i] = [v / m[i][i] for v in m[i]]
            for j in range(k):
                if j != i:
                    m[j] = [a - m[j][i] * b for a, b in zip(m[j], m[i])]
        beta = [r[k] for r in m]
        sse = sum((v - sum(a * b for a, b in zip(r, beta))) ** 2 for r, v in zip(z, y))
        return float(beta[1]), float(sse), float(m[1][k + 1]), len(y), k

    def aic(p):
        _, sse, _, n, k = solve(p, most)
        return n * math.log(sse / n) + 2 * k

    p = min(range(most + 1), key=aic)
    b, sse, inverse, n, k = solve(p, p)
    t, prob, lags = reversion.adf(x)
    assert lags == p and abs(t - b / math.sqrt(sse / (n - k) * inverse)) < 1e-6 and abs(prob - reversion.mackinnon_p(t)) < 1e-12
