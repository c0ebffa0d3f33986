"""DuckDB SQL of the panel queries."""

from __future__ import annotations

from .panels import UNIVERSE
from .queries import DATES, FILES, HEADERS, NUMBERS


def values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


TYPES = """
v1 AS (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close,
  avg(l_extendedprice * (1 - l_discount) / l_quantity) AS nav, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT *, close / nav - 1 AS premium, (close / nav - 1) * 10000 AS premium_bps FROM v1)"""
SEGMENTS = """
px AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nv AS (SELECT c_mktsegment AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) * 5 AS nav
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
HOURS = """
v3 AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, avg(value) AS nav FROM events GROUP BY 1, 2),
p AS (SELECT *, (close / nav - 1) * 10000 AS premium_bps FROM v3),
r0 AS (SELECT ticker, date, (nav / lag(nav) OVER w - 1) * 10000 AS ret FROM v3 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
r AS (SELECT ticker, date, lead(ret) OVER w AS lead_bps, ret AS same_bps, lag(ret) OVER w AS lag_bps FROM r0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
j AS (SELECT p.ticker, p.date, premium_bps, lead_bps, same_bps, lag_bps FROM p JOIN r ON p.ticker = r.ticker AND p.date = r.date)"""
BANDS = f"u AS (SELECT * FROM (VALUES {values(UNIVERSE)}) AS t(ticker, sleeve, band_bps, foreign_session, role))"
ROLLING = "CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY date ROWS {k} PRECEDING) = {k} + 1 THEN avg(premium_bps) OVER (PARTITION BY ticker ORDER BY date ROWS {k} PRECEDING) END"


def series(kind: str = "ma5") -> str:
    value = {"raw": "premium_bps", "ma5": ROLLING.format(k=4), "ma20": ROLLING.format(k=19)}[kind]
    return f"{TYPES}, s AS (SELECT ticker, date, x FROM (SELECT ticker, date, round({value}, 6) AS x FROM p) WHERE x IS NOT NULL)"


def fit(kind: str = "ma5") -> str:
    return series(kind) + """,
pr AS (SELECT ticker, date, x AS y, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS x FROM s),
pq AS (SELECT * FROM pr WHERE x IS NOT NULL),
f0 AS (SELECT ticker, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx FROM pq GROUP BY ticker),
f1 AS (SELECT pq.ticker, a, b, count(*) AS n, sum((x - mx) ** 2) AS sxx, sum((x - mx) ** 2 * (y - a - b * x) ** 2) AS meat, sum((y - a - b * x) ** 2) AS sse
  FROM pq JOIN f0 ON pq.ticker = f0.ticker GROUP BY pq.ticker, a, b),
f AS (SELECT ticker, a, b, sqrt(n * meat / ((n - 2) * sxx * sxx)) AS b_se, sqrt(sse / (n - 2)) AS resid_sd, n FROM f1),
h AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) END AS half_life FROM f),
i AS (SELECT ticker, b, half_life, greatest(half_life - 1.959963984540054 * abs(ln(2) / (b * ln(b) ** 2)) * b_se, 0.0) AS lower,
  half_life + 1.959963984540054 * abs(ln(2) / (b * ln(b) ** 2)) * b_se AS upper FROM h)"""


INTRADAY = """, b0 AS (SELECT ticker, date, premium_bps, (high / nav - 1) * 10000 AS hi, (low / nav - 1) * 10000 AS lo FROM p),
ip AS (SELECT ticker, count(*) AS n, median(hi - lo) AS median_range_bps, median(abs(premium_bps)) AS median_close_bps,
  avg(CASE WHEN hi > 0 AND lo < 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_straddle,
  median(abs(CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END - premium_bps)) AS median_unwound_bps FROM b0 GROUP BY ticker)"""
RESULTS = fit() + INTRADAY + f""", {BANDS},
res AS (SELECT i.ticker, half_life, lower, upper, median_range_bps, sleeve, role,
  CASE WHEN sleeve IN ('equity_us_large', 'equity_us_total', 'equity_intl_developed', 'equity_em') THEN 'equity' ELSE 'credit' END AS grp
  FROM i JOIN ip ON i.ticker = ip.ticker JOIN u ON i.ticker = u.ticker),
prs AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, a.grp AS group_a, b.grp AS group_b,
  CASE WHEN a.lower IS NULL OR b.lower IS NULL THEN TRUE ELSE a.lower <= b.upper AND b.lower <= a.upper END AS overlap
  FROM res a JOIN res b ON a.ticker < b.ticker WHERE a.half_life IS NOT NULL AND b.half_life IS NOT NULL)"""


def alignment(where: str = "TRUE") -> str:
    return f"""WITH {SEGMENTS}, a AS (SELECT coalesce(q.ticker, n.ticker) AS ticker, q.ticker IS NOT NULL AS ip, n.ticker IS NOT NULL AS inn
  FROM (SELECT * FROM px WHERE {where}) q FULL OUTER JOIN (SELECT * FROM nv WHERE {where}) n ON q.ticker = n.ticker AND q.date = n.date)
SELECT ticker, count(*) FILTER (ip) AS n_price, count(*) FILTER (inn) AS n_nav, count(*) FILTER (ip AND inn) AS n_aligned, CAST(0 AS BIGINT) AS n_dropped_na,
  count(*) FILTER (NOT inn) AS n_price_only, count(*) FILTER (NOT ip) AS n_nav_only, count(*) FILTER (NOT ip OR NOT inn) AS n_dropped FROM a GROUP BY ticker"""


FLAGS = f"""{TYPES}, {BANDS},
m AS (SELECT p.*, band_bps, abs(close / lag(close) OVER w - 1) * 10000 AS mc, abs(nav / lag(nav) OVER w - 1) * 10000 AS mn
  FROM p JOIN u ON p.ticker = u.ticker WINDOW w AS (PARTITION BY p.ticker ORDER BY date)),
fl AS (SELECT ticker, date, coalesce(mn <= 50, FALSE) AS nav_unchanged, coalesce(mn <= 50, FALSE) AND coalesce(mc, 0) > 25 AS stale_nav, abs(premium_bps) > band_bps AS extreme_premium FROM m),
il AS (SELECT ticker, nav_unchanged, sum(CASE WHEN nav_unchanged THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS island FROM fl),
lr AS (SELECT ticker, max(n) AS longest_run FROM (SELECT ticker, island, count(*) FILTER (nav_unchanged) AS n FROM il GROUP BY ticker, island) GROUP BY ticker)"""


def spread(adjust: bool, clip: bool = False) -> str:
    gap = "coalesce(greatest(lag(close) OVER w - high, 0.0) - greatest(low - lag(close) OVER w, 0.0), 0.0)" if adjust else "0.0"
    out = "CASE WHEN s IS NOT NULL THEN greatest(s, 0.0) END" if clip else "s"
    return f"""{TYPES},
g AS (SELECT ticker, date, close, volume, high, low, lag(high) OVER w AS h1, lag(low) OVER w AS l1, high + {gap} AS h2, low + {gap} AS l2 FROM v1 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
bg AS (SELECT *, ln(h1 / l1) ** 2 + ln(h2 / l2) ** 2 AS beta, CASE WHEN h1 IS NOT NULL THEN ln(greatest(h1, h2) / least(l1, l2)) ** 2 END AS gamma FROM g),
al AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM bg),
ss AS (SELECT *, 2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS s FROM al),
sp AS (SELECT ticker, date, close, volume, high, low, s, {out} AS spread FROM ss)"""


def ratios() -> str:
    lags = ", ".join(f"lag(v, {q}) OVER w AS x{q}" for q in (2, 5, 10, 20)) + ", " + ", ".join(f"lag(c, {j}) OVER w AS c{j}" for j in range(1, 20))
    parts = []
    for q in (2, 5, 10, 20):
        theta = " + ".join(f"{(2 * (q - j) / q) ** 2!r} * sum(c * c{j})" for j in range(1, q))
        parts.append(f"""SELECT ticker, {q} AS horizon, count(d) + 1 AS n,
  CASE WHEN count(d) + 1 >= {10 * q} THEN sum((v - x{q} - {q} * mu) ** 2) / ({q} * (count(d) - {q} + 1.0) * (1 - {q}.0 / count(d))) / (sum(c) / (count(d) - 1)) END AS ratio,
  sqrt(({theta}) / (sum(c) * sum(c))) AS se FROM l GROUP BY ticker""")
    return series("raw") + f""",
d0 AS (SELECT ticker, date, x AS v, x - lag(x) OVER (PARTITION BY ticker ORDER BY date) AS d FROM s),
d1 AS (SELECT *, avg(d) OVER (PARTITION BY ticker) AS mu FROM d0),
d2 AS (SELECT *, (d - mu) ** 2 AS c FROM d1),
l AS (SELECT *, {lags} FROM d2 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
vr AS (SELECT ticker, horizon, n, ratio, (ratio - 1) / se AS z FROM ({" UNION ALL ".join(parts)}))"""


def regression(y: str, table: str = "j") -> str:
    return f"""SELECT ticker, round(regr_slope({y}, premium_bps), 6) AS slope,
  round(regr_slope({y}, premium_bps) / sqrt((1 - regr_r2({y}, premium_bps)) * regr_syy({y}, premium_bps) / regr_sxx({y}, premium_bps) / (regr_count({y}, premium_bps) - 2)), 6) AS t_stat,
  round(regr_r2({y}, premium_bps), 6) AS r2, CAST(regr_count({y}, premium_bps) AS BIGINT) AS n FROM {table} GROUP BY ticker"""


def hashed(tag: str, seed: int, *parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(concat('0x', substr(md5('{tag}|{seed}|' || {text}), 1, 8)) AS BIGINT)"


def indices(sizes: str, n_boot: int, seed: int, block: str) -> str:
    return f"""gr AS (SELECT ticker, m, rep, unnest(range(0, m)) AS i FROM (SELECT ticker, m, unnest(range(1, {n_boot} + 1)) AS rep FROM {sizes})),
nb AS (SELECT *, CASE WHEN i = 0 OR {hashed("n", seed, "ticker", "rep", "i - 1")} / 4294967296.0 < 1 / {block} THEN 1 ELSE 0 END AS new FROM gr),
bl AS (SELECT *, CAST(sum(new) OVER (PARTITION BY ticker, rep ORDER BY i) AS BIGINT) AS blk FROM nb),
ix AS (SELECT ticker, rep, i, ({hashed("s", seed, "ticker", "rep", "blk")} % m + row_number() OVER (PARTITION BY ticker, rep, blk ORDER BY i) - 1) % m AS idx FROM bl)"""


SQL: dict[str, str] = {
    "premium_series": f"WITH {TYPES} SELECT ticker, date, round(close, 6) AS close, round(nav, 6) AS nav, round(premium, 6) AS premium, round(premium_bps, 6) AS premium_bps FROM p",
    "premium_custom_cols": f"WITH {TYPES} SELECT ticker, date, round((high / low - 1) * 10000, 6) AS premium_bps FROM p",
    "premium_describe": f"""WITH {TYPES} SELECT ticker, count(*) AS n, round(avg(premium_bps), 6) AS mean_bps, round(median(premium_bps), 6) AS median_bps, round(stddev_samp(premium_bps), 6) AS sd_bps,
  round(min(premium_bps), 6) AS min_bps, round(max(premium_bps), 6) AS max_bps, round(avg(CASE WHEN premium_bps > 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_positive,
  round(avg(premium_bps) / (stddev_samp(premium_bps) / sqrt(count(*))), 6) AS t_stat FROM p GROUP BY ticker""",
    "align_inner": f"WITH {SEGMENTS} SELECT px.ticker, px.date, round(close, 6) AS close, round(nav, 6) AS nav FROM px JOIN nv ON px.ticker = nv.ticker AND px.date = nv.date",
    "align_report": alignment(),
    "align_window": alignment("date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"),
    "align_price_only": f"WITH {SEGMENTS} SELECT ticker, date FROM px EXCEPT SELECT ticker, date FROM nv",
    "align_nav_only": f"WITH {SEGMENTS} SELECT ticker, date FROM nv EXCEPT SELECT ticker, date FROM px",
    "quality_flags": f"WITH {FLAGS} SELECT * FROM fl",
    "quality_report": f"""WITH {FLAGS} SELECT fl.ticker, count(*) AS n_obs, count(*) FILTER (stale_nav) AS n_stale, count(*) FILTER (extreme_premium) AS n_extreme, any_value(longest_run) AS longest_run,
  round(count(*) FILTER (stale_nav) * 100.0 / count(*), 6) AS pct_stale, round(count(*) FILTER (extreme_premium) * 100.0 / count(*), 6) AS pct_extreme FROM fl JOIN lr ON fl.ticker = lr.ticker GROUP BY fl.ticker""",
    "quality_longest_run": f"WITH {FLAGS} SELECT * FROM lr",
    "quality_top5": f"WITH {TYPES} SELECT ticker, date, round(premium_bps, 6) AS premium_bps, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(premium_bps) DESC, date) AS k FROM p) WHERE k <= 5",
    "intraday_bounds": f"WITH {TYPES} SELECT ticker, date, round((high / nav - 1) * 10000, 6) AS premium_high_bps, round((low / nav - 1) * 10000, 6) AS premium_low_bps, round((high / nav - 1) * 10000 - (low / nav - 1) * 10000, 6) AS premium_range_bps FROM p",
    "intraday_profile": f"""WITH {TYPES} {INTRADAY} SELECT ticker, n, round(median_range_bps, 6) AS median_range_bps, round(median_close_bps, 6) AS median_close_bps, round(pct_straddle, 6) AS pct_straddle,
  round(median_unwound_bps, 6) AS median_unwound_bps, round(CASE WHEN median_close_bps > 0 THEN median_range_bps / median_close_bps ELSE CAST('inf' AS DOUBLE) END, 6) AS range_to_close FROM ip""",
    "liquidity_profile": f"""WITH {spread(True)} SELECT ticker, round(median(close * volume), 4) AS median_dollar_volume, round(avg(close * volume), 4) AS mean_dollar_volume, round(avg(s) * 10000, 4) AS spread_bps,
  round(avg(CASE WHEN s IS NOT NULL THEN greatest(s, 0.0) END) * 10000, 4) AS spread_clipped_bps, round(avg(CASE WHEN round(s, 12) < 0 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) * 100, 4) AS pct_negative,
  round(median((high - low) / close * 10000), 4) AS median_range_bps, avg(s) > 0 AS spread_is_usable FROM sp GROUP BY ticker""",
    "cs_spread_raw": f"WITH {spread(False)} SELECT ticker, date, round(spread, 6) + 0.0 AS spread FROM sp",
    "cs_spread_adjusted": f"WITH {spread(True)} SELECT ticker, date, round(spread, 6) + 0.0 AS spread FROM sp",
    "cs_spread_clipped": f"WITH {spread(True, True)} SELECT ticker, date, round(spread, 6) + 0.0 AS spread FROM sp",
    "ar1_fit_hc1": f"WITH {fit()} SELECT ticker, round(a, 6) AS a, round(b, 6) AS b, round(b_se, 6) AS b_se, round(resid_sd, 6) AS resid_sd, n, round(b / b_se, 6) AS t_stat FROM f",
    "half_life": f"WITH {fit()} SELECT ticker, round(half_life, 6) AS half_life, round(ln(2) / half_life, 6) AS kappa FROM h",
    "delta_interval": f"WITH {fit()} SELECT ticker, round(lower, 6) AS lower, round(upper, 6) AS upper FROM i",
    "long_run": f"WITH {fit('ma20')} SELECT ticker, round(a / (1 - b), 6) AS level FROM f",
    "variance_ratios": f"WITH {ratios()} SELECT ticker, horizon, n, round(ratio, 6) AS ratio, round(z, 6) AS z FROM vr",
    "variance_ratio_profile": f"""WITH {ratios()}, w AS (SELECT *, coalesce(lead(ratio) OVER (PARTITION BY ticker ORDER BY horizon) <= ratio, TRUE) AS falls FROM vr)
SELECT ticker, bool_and(ratio < 1) AS all_below_one, bool_and(falls) AS monotone_decreasing, bool_or(abs(z) > 1.959964) AS any_rejects, bool_and(ratio < 1) AND bool_or(abs(z) > 1.959964) AS confirms_mean_reversion FROM w GROUP BY ticker""",
    "discovery_lead": f"WITH {HOURS} {regression('lead_bps')}",
    "discovery_placebo": f"WITH {HOURS} {regression('lag_bps')}",
    "discovery_verdict": f"""WITH {HOURS}, o AS ({regression('lead_bps')}), b AS (SELECT ticker, regr_r2(lag_bps, premium_bps) AS pr2, regr_slope(lag_bps, premium_bps) AS ps FROM j GROUP BY ticker)
SELECT o.ticker, slope, t_stat, r2, n, round(pr2, 6) AS placebo_r2, round(ps, 6) AS placebo_slope, slope > 0.2 AND abs(t_stat) > 3 AND r2 > 0.02 AND r2 > 4 * pr2 AS is_price_discovery FROM o JOIN b ON o.ticker = b.ticker""",
    "gap_session_split": f"""WITH {HOURS}, g0 AS (SELECT ticker, date, (open / lag(close) OVER w - 1) * 10000 AS g, (close / open - 1) * 10000 AS s, (close / lag(close) OVER w - 1) * 10000 AS t FROM v3 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
g1 AS (SELECT ticker, date, lead(g) OVER w AS gap, lead(s) OVER w AS session, lead(t) OVER w AS total FROM g0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
k AS (SELECT p.ticker, premium_bps, gap, session, total FROM p JOIN g1 ON p.ticker = g1.ticker AND p.date = g1.date WHERE premium_bps IS NOT NULL AND gap IS NOT NULL AND session IS NOT NULL AND total IS NOT NULL)
SELECT ticker, round(regr_slope(gap, premium_bps), 6) AS slope_gap, round(regr_slope(session, premium_bps), 6) AS slope_session, round(regr_slope(total, premium_bps), 6) AS slope_total, count(*) AS n,
  round(regr_slope(gap, premium_bps) / regr_slope(total, premium_bps), 6) AS gap_share FROM k GROUP BY ticker""",
    "same_next_day": f"""WITH {HOURS} SELECT ticker, round(regr_slope(same_bps, premium_bps), 6) AS same_slope, round(regr_r2(same_bps, premium_bps), 6) AS same_r2, round(regr_slope(lead_bps, premium_bps), 6) AS next_slope,
  round(regr_r2(lead_bps, premium_bps), 6) AS next_r2 FROM j WHERE same_bps IS NOT NULL AND lead_bps IS NOT NULL GROUP BY ticker""",
    "bootstrap_indices": f"WITH sz AS (SELECT * FROM (VALUES ('A', 60), ('B', 37)) AS t(ticker, m)), {indices('sz', 20, 3, '6.0')} SELECT ticker, CAST(rep AS INTEGER) AS rep, CAST(i AS BIGINT) AS i, CAST(idx AS BIGINT) AS idx FROM ix",
    "bootstrap_interval": f"""WITH {fit()}, sz AS (SELECT ticker, count(*) AS m FROM pq GROUP BY ticker), {indices('sz', 40, 0, 'greatest(2.0, (m + 1) ** (1.0 / 3))')},
nn AS (SELECT ticker, x, y, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx FROM pq),
rp AS (SELECT ix.ticker, rep, regr_slope(y, x) AS b FROM ix JOIN nn ON ix.ticker = nn.ticker AND ix.idx = nn.idx GROUP BY ix.ticker, rep),
rh AS (SELECT ticker, CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) END AS h FROM rp)
SELECT ticker, count(h) AS n_valid, round(CASE WHEN count(h) >= 20 THEN quantile_cont(h, 0.025) END, 6) AS lower, round(CASE WHEN count(h) >= 20 THEN quantile_cont(h, 0.975) END, 6) AS upper FROM rh GROUP BY ticker""",
    "cross_section_table": f"WITH {RESULTS} SELECT ticker, sleeve, grp AS asset_group, role, round(half_life, 6) AS half_life, round(lower, 6) AS lower, round(upper, 6) AS upper, round(median_range_bps, 6) AS median_range_bps FROM res",
    "separation_pairs": f"WITH {RESULTS} SELECT * FROM prs",
    "separation_counts": f"""WITH {RESULTS} SELECT count(*) FILTER (group_a <> group_b) AS cross_pairs, count(*) FILTER (group_a <> group_b AND overlap) AS cross_overlaps,
  count(*) FILTER (group_a = 'credit' AND group_b = 'credit') AS credit_pairs, count(*) FILTER (group_a = 'credit' AND group_b = 'credit' AND overlap) AS credit_overlaps FROM prs""",
    "overlap_matrix": f"WITH {RESULTS} SELECT ticker_a AS a, ticker_b AS b, overlap FROM prs UNION ALL SELECT ticker_b, ticker_a, overlap FROM prs UNION ALL SELECT ticker, ticker, TRUE FROM res WHERE half_life IS NOT NULL",
    "plot_order": f"WITH {RESULTS} SELECT ticker, role = 'primary' AND half_life IS NOT NULL AS has_estimate, round(CASE WHEN role = 'primary' THEN half_life END, 6) AS half_life, CASE WHEN role = 'primary' AND half_life IS NOT NULL THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS bound, round(median_range_bps, 6) AS median_range_bps FROM res",
    "yearly_premium": f"WITH {TYPES} SELECT ticker, CAST(year(date) AS INTEGER) AS year, round(avg(premium_bps), 6) AS mean_bps, count(premium_bps) AS n FROM p GROUP BY 1, 2",
    "exdiv_split": f"""WITH {TYPES} SELECT ticker, round(avg(premium_bps) FILTER (day(date) = 1), 6) AS mean_on, count(*) FILTER (day(date) = 1) AS n_on, round(avg(premium_bps) FILTER (day(date) <> 1), 6) AS mean_off,
  count(*) FILTER (day(date) <> 1) AS n_off, round(avg(premium_bps) FILTER (day(date) = 1) - avg(premium_bps) FILTER (day(date) <> 1), 6) AS difference FROM p GROUP BY ticker""",
    "premium_histogram": f"""WITH {TYPES}, q AS (SELECT ticker, round(premium_bps, 4) AS x FROM p), e AS (SELECT ticker, min(x) AS lo, max(x) AS hi FROM q GROUP BY ticker)
SELECT q.ticker, CAST(least(coalesce(floor((x - lo) * 90 / (hi - lo)), 0), 89) AS INTEGER) AS bin, count(*) AS n FROM q JOIN e ON q.ticker = e.ticker GROUP BY 1, 2""",
    "extreme_dates": f"""WITH {TYPES}, q AS (SELECT ticker, date, round(premium_bps, 4) AS x FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY x DESC, date) AS top, row_number() OVER (PARTITION BY ticker ORDER BY x, date) AS low FROM q)
SELECT ticker, max(date) FILTER (top = 1) AS max_date, max(date) FILTER (low = 1) AS min_date FROM k GROUP BY ticker""",
    "large_dev_share": f"WITH {TYPES} SELECT ticker, round(avg(CASE WHEN abs(premium_bps) > 500 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_large FROM p GROUP BY ticker",
    "clean_numeric": f"""SELECT i, CASE WHEN s IN ('', '-', '--', 'N/A', 'n/a') THEN NULL ELSE try_cast(s AS DOUBLE) END AS value FROM (
  SELECT i, regexp_replace(regexp_replace(raw, '[$,\\s]', '', 'g'), '^\\((.*)\\)$', '-\\1') AS s FROM (VALUES {values(list(enumerate(NUMBERS)))}) AS t(i, raw))""",
    "normalise_header": f"""SELECT i, lower(regexp_replace(trim(regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g')), '\\s+', ' ', 'g')) AS header FROM (VALUES {values(list(enumerate(HEADERS)))}) AS t(i, raw)""",
    "parse_dates": f"""SELECT i, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%b %-d, %Y'), try_strptime(raw, '%-m/%-d/%Y'), try_strptime(raw, '%-d-%b-%Y'), try_strptime(raw, '%Y%m%d')) AS DATE) AS date
  FROM (VALUES {values(list(enumerate(DATES)))}) AS t(i, raw)""",
    "nav_sniff": "SELECT * FROM (VALUES " + values(list(enumerate(["xlsx", "spreadsheetml", "spreadsheetml", "html", "markup", "csv", "html"]))) + ") AS t(i, format)",
}
assert len(FILES) == 7
