import zipfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans import report
from tidemark.sources import nav_files, prices
from tidemark.sources.universe import ConfigError, load_universe

GOOD = """
sample: {start: 2018-01-02, end: null}
funds:
  - {ticker: AAA, name: A, sleeve: debt_em, issuer: X, foreign_session: true, outlier_band_bps: 300, role: primary}
  - {ticker: BBB, name: B, sleeve: equity_em, issuer: X, foreign_session: false, outlier_band_bps: 100, role: control}
"""


def test_universe(spark, tmp_path):
    f = tmp_path / "u.yaml"
    f.write_text(GOOD)
    u = load_universe(f)
    assert list(u.rows) == ["AAA", "BBB"] and [r.ticker for r in u.primary(spark).collect()] == ["AAA"] and u.rows["BBB"]["role"] == "control"
    assert u.start == date(2018, 1, 2) and u.end == date.today() and u.frame(spark).count() == 2
    for a, b in (("role: control", "role: other"), ("foreign_session: true", "foreign_session: 1"), ("300", "-1"), ("300", "true"), ("BBB", "AAA"), ("issuer: X, ", ""), ("start: 2018-01-02", "start: soon"), ("end: null", "end: 2017-01-01"), ("sample:", "smpl:")):
        f.write_text(GOOD.replace(a, b, 1))
        with pytest.raises(ConfigError):
            load_universe(f)
    f.write_text(GOOD.replace("300", "-1").replace("role: control", "role: other"))
    with pytest.raises(ConfigError, match="fund 0 .*; fund 1 "):
        load_universe(f)
    for bad in ("[]", "sample: {start: 2018-01-02}\nfunds: []", "sample: {start: 2018-01-02}\nfunds: [1]", "sample: x\nfunds: [1]"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load_universe(f)
    with pytest.raises(ConfigError):
        load_universe(tmp_path / "none.yaml")


def price_rows(spark, n=5, adj=0.9):
    return spark.range(n).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("Date"), *((F.col("id") * 1.0 + 10).alias(c) for c in ("Open", "High", "Low", "Close")), ((F.col("id") * 1.0 + 10) * adj).alias("Adj Close"), F.lit(5).alias("Volume"))


def test_prices(spark, tmp_path):
    p = prices.check_prices(prices.normalise(price_rows(spark)))
    assert p.columns == ["ticker", "date", *prices.REQUIRED]
    path = str(tmp_path / "store")
    prices.write_prices(p, path)
    assert prices.read_prices(spark, path, "2024-01-02", "2024-01-03", ["A"]).count() == 2
    with pytest.raises(prices.PriceDataError, match="adjusted"):
        prices.normalise(price_rows(spark).drop("Adj Close"))
    with pytest.raises(prices.PriceDataError, match="adjusted"):
        prices.check_prices(prices.normalise(price_rows(spark, 300, 1.0)))
    for bad in (p.withColumn("close", F.lit(-1.0)), p.withColumn("close", F.lit(None).cast("double")), p.union(p), p.limit(0)):
        with pytest.raises(prices.PriceDataError):
            prices.check_prices(bad)
    nested = price_rows(spark).select("Date", F.struct("Open", "High", "Low", "Close", "Adj Close", "Volume").alias("QQQ"))
    assert prices.normalise(nested, "QQQ").count() == 5
    with pytest.raises(prices.PriceDataError, match="not present"):
        prices.normalise(nested, "ZZZ")


def sheet(rows):
    cell = lambda c: f"<Cell{c}</Cell>"
    return '<?xml version="1.0"?>\n<Workbook xmlns:ss="urn:s"><Worksheet ss:Name="R & D"><Table>' + "".join("<Row>" + "".join(map(cell, r)) + "</Row>" for r in rows) + "</Table></Worksheet></Workbook>"


def test_nav_files(spark, tmp_path):
    d = tmp_path / "nav"
    d.mkdir()
    (d / "aaa.csv").write_text('﻿Fund AAA\n"As Of","NAV","x"\n"Jan 2, 2024","$1,000.50",\n2024-01-03,--,\n1/4/2024,12,\n\n')
    (d / "bbb.xml").write_text(sheet([[">title"], [' ss:Index="2"><Data>As Of</Data>', "><Data>NAV per Share</Data>"], [' ss:Index="2"><Data>2024-01-02</Data>', "><Data>(5)</Data>"], [' ss:Index="2"><Data>2024-01-03</Data>', "><Data>6 &amp; </Data>"]]))
    with zipfile.ZipFile(d / "ccc.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Date</t></si><si><t>NAV</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>1</v></c></row><row><c r="B2" t="inlineStr"><is><t>2024-01-02</t></is></c><c r="D2"><v>7.5</v></c></row></sheetData></worksheet>')
    raw = nav_files.read_nav_files(spark, str(d))
    got = {(r.ticker, str(r.date), r.nav) for r in raw.select(F.upper(F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).alias("ticker"), T.mixed_date(F.col("raw_date")).alias("date"), T.number(F.col("raw_nav")).alias("nav")).collect()}
    assert got == {("AAA", "2024-01-02", 1000.5), ("AAA", "2024-01-03", None), ("AAA", "2024-01-04", 12.0), ("BBB", "2024-01-02", -5.0), ("BBB", "2024-01-03", None), ("CCC", "2024-01-02", 7.5)}
    only = raw.where("path LIKE '%aaa%'")
    assert nav_files.nav_series(only, min_rows=2).count() == 2
    for rows, kind in ((only, "fewer than 1000"), (only.union(only), "duplicate"), (raw.where("path LIKE '%bbb%' AND row = 0"), "not positive"), (only.withColumn("raw_nav", F.lit("x")), "half")):
        with pytest.raises(nav_files.NavFileError, match=kind):
            nav_files.nav_series(rows, min_rows=1000 if "1000" in kind else 1)
    with pytest.raises(nav_files.NavFileError, match="range"):
        nav_files.nav_series(only.withColumn("raw_nav", F.lit("20000")), min_rows=1)
    (d / "bbb.csv").write_text("x")
    assert {r.ticker: r.path[-3:] for r in nav_files.choose_files(spark, str(d)).collect()} == {"AAA": "csv", "BBB": "csv", "CCC": "lsx"}
    (d / "ddd.csv").write_text("<!DOCTYPE html><html></html>")
    with pytest.raises(Exception, match="web page"):
        nav_files.read_nav_files(spark, str(d), "ddd*").collect()


@pytest.mark.parametrize("names", [("As Of", "NAV per Share"), ("As Of Date", "NAV ($)"), ("AsOf", "NAV per Share ($)"), ("Trade Date", "NAV per share (USD)"), ("Record Date", "Net Asset Value"), ("NAV Date", "Net Asset Value per Share"), ("Date", "Closing NAV"), ("date", "nav")])
def test_header_names(names):
    rows = [["Fund"], [f' "{names[0]}"', f"{names[1]}  "], ["2024-01-02", "1"]]
    assert nav_files.table_rows(rows)[1] == [["2024-01-02", "1"]]
    assert nav_files.table_rows([["Pricing Date", "NAV"]]) is None and nav_files.table_rows([["Date", "NAV/Share"]]) is None


def test_entities_and_dates(spark, tmp_path):
    rows = nav_files.spreadsheetml_sheets(sheet([["><Data>R&amp;D &nbsp;&style=All &#65;</Data>"]]).replace("R & D", "Historical"))
    assert list(rows) == [("Historical", [["R&D &nbsp;&style=All A"]])]
    raw = ["2018-01-02T00:00:00", "2018-01-02T00:00:00.000", "January 2, 2018", "2 January 2018", "Jan 02, 2018", "2018/1/2", "1/2/2018", "2018-01-02 00:00:00"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(T.mixed_date(F.col("r"))).collect()
    assert {str(g[0]) for g in got} == {"2018-01-02"}


def workbook(path, styles=True):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="About" sheetId="1"/><sheet name="Historical" sheetId="2"/></sheets></workbook>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="&quot;day&quot; yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        cell = lambda ref, v, s=0: f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
        text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row>{text("A1", "about")}</row></sheetData></worksheet>')
        body = f'<row>{text("A1", "Date")}{text("B1", "NAV")}{text("C1", "Ex-Dividends")}</row><row>{cell("A2", 43102, 1)}{cell("B2", 43102, 3)}{text("C2", "--")}</row><row>{cell("A3", 43103.5, 2)}{cell("B3", 81.5)}{text("C3", "0.2")}</row>'
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_dates_and_ex_dates(spark, tmp_path):
    workbook(tmp_path / "abc.xlsx")
    sheets = dict(nav_files.xlsx_sheets((tmp_path / "abc.xlsx").read_bytes()))
    assert [r[:2] for r in sheets["Historical"][1:]] == [["2018-01-02", "43102"], ["2018-01-03T12:00:00", "81.5"]]
    days = nav_files.ex_dates(spark, str(tmp_path)).collect()
    assert [(r.ticker, str(r.date)) for r in days] == [("ABC", "2018-01-03")]
    with pytest.raises(Exception, match="no row names both"):
        nav_files.ex_dates(spark, str(tmp_path), sheet="About").collect()


def test_load_nav_file(spark, tmp_path):
    body = "Fund\n\nInception,2001\n\"As Of\",\"NAV per Share\"\n" + "".join(f'"{(date(2018, 1, 2) + timedelta(i)).strftime("%b %d, %Y")}","80.00"\n' for i in range(1200)) + "Disclaimer,\n"
    (tmp_path / "hyg.csv").write_text(body)
    assert nav_files.load_nav_file(spark, str(tmp_path)).groupBy("ticker").count().first()[:] == ("HYG", 1200)
    assert nav_files.load_nav_file(spark, str(tmp_path / "hyg.csv")).agg(F.min("date")).first()[0] == date(2018, 1, 2)
    for missing in ("none.csv", "none"):
        with pytest.raises(nav_files.NavFileError, match="no file"):
            nav_files.load_nav_file(spark, str(tmp_path / missing)).collect()


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.23456, 7)], "ticker string, x double, n long")
    report.write_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == "ticker,x,n\nA,1.2346,7\n"
    q = spark.createDataFrame([("A", 2185, 48, 2.19679, 3, 0.1373, 4, 500.0)], "ticker string, n_obs long, n_stale long, pct_stale double, n_extreme long, pct_extreme double, longest_run long, band_bps double")
    assert report.as_lines(q, "quality").first().line == "A: n=2185 stale_nav=48 (2.20%) extreme>500bps=3 (0.14%) longest_nav_run=4"
    assert report.as_rows(q, "quality").first().asDict() == {"ticker": "A", "n_obs": 2185, "n_stale_nav": 48, "pct_stale": 2.197, "n_extreme_premium": 3, "pct_extreme": 0.137, "longest_nav_run": 4, "band_bps": 500.0}
    d = spark.createDataFrame([("A", "nav", 0.92, 18.2, 0.14, 0.006, True, True)], "ticker string, target string, slope double, t_stat double, r2 double, placebo_r2 double, external boolean, is_price_discovery boolean")
    assert report.as_lines(d, "discovery").first().line == "A->nav: slope +0.92 t=+18.2 R2=0.140 (placebo 0.006) [external] leads the target"
    assert report.as_rows(d, "discovery").first().price_discovery
