"""Published-value files: sniffed by content, read by table functions, guarded before use."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Header names that mark the date and the value column; fixed values.
DATE_NAMES = ["as of", "as of date", "asof", "date", "trade date", "record date", "nav date"]
NAV_NAMES = ["nav per share", "nav per share ($)", "nav per share (usd)", "nav", "nav ($)", "net asset value", "net asset value per share", "closing nav"]
#: An ampersand that begins no entity of XML itself; fixed value.
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)"
#: Suffixes in the order in which a file is chosen; fixed values.
SUFFIXES = ["xls", "xlsx", "csv", "xml"]
HEADER_ROWS = 80


class NavFileError(ValueError):
    """A file that must not be used; says why."""


def sniff_format(content: Column) -> Column:
    """xlsx, html, spreadsheetml, markup (unknown) or csv, from the first bytes."""
    head = F.substring(content, 1, 16_000)  # bytes: 4,000 characters of up to four each
    words = F.lower(F.left(F.regexp_replace(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "^\ufeff", ""), r"^\s+", ""), F.lit(4000)))
    return (
        F.when(F.hex(F.substring(content, 1, 4)) == "504B0304", "xlsx")
        .when(words.startswith("<!doctype html") | words.startswith("<html") | F.left(words, F.lit(2000)).contains("<head>"), "html")
        .when(words.startswith("<?xml") | words.contains("<ss:workbook") | words.contains("<workbook"), "spreadsheetml")
        .when(words.startswith("<"), "markup")
        .otherwise("csv")
    )


def plain_header(cell: str) -> str:
    return " ".join(cell.strip().strip('"').lower().split())


def has_header(cells: list) -> bool:
    names = {plain_header(c) for c in cells}
    return bool(names & set(DATE_NAMES)) and bool(names & set(NAV_NAMES))


def table_rows(rows: list):
    """(header, rows below it, cut or padded to its width, blank rows dropped), or None."""
    for i, cells in enumerate(rows[:HEADER_ROWS]):
        if has_header(cells):
            width = len(cells)
            body = [(r + [""] * width)[:width] for r in rows[i + 1 :]]
            return cells, [r for r in body if any(c.strip() for c in r)]
    return None


#: Number formats of dates and times that workbooks have built in; fixed values.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def date_styles(z: zipfile.ZipFile, main: str) -> set:
    """Cell styles that show numbers as dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    bare = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{main}numFmt") if re.search("[dmyhs]", bare(f.get("formatCode", "")), re.I)}
    cells = root.find(f"{main}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def serial_date(value: str, epoch: datetime) -> str:
    """A workbook's day number as text."""
    when = epoch + timedelta(days=float(value))
    return when.date().isoformat() if when == datetime(when.year, when.month, when.day) else when.isoformat(timespec="seconds")


def xlsx_sheets(content: bytes):
    """(name, rows of text) of each sheet of an OOXML workbook, in order; dates by their cells' styles."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared, named, epoch = [], {}, datetime(1899, 12, 30)
        dates = date_styles(z, main)
        if "xl/workbook.xml" in z.namelist():
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            named = {i: s.get("name") for i, s in enumerate(book.iter(f"{main}sheet"), 1)}
            if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{main}workbookPr")):
                epoch = datetime(1904, 1, 1)
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for place, number in enumerate(numbers, 1):
            rows, name = [], f"xl/worksheets/sheet{number}.xml"
            for row in ElementTree.fromstring(z.read(name)).iter(f"{main}row"):
                cells: list = []
                for c in row.iter(f"{main}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    value = c.findtext(f"{main}v") or ""
                    if c.get("t") == "s":
                        value = shared[int(value)] if value else ""
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{main}t"))
                    elif c.get("t", "n") == "n" and value and int(c.get("s", 0)) in dates:
                        value = serial_date(value, epoch)
                    cells += [""] * (at - len(cells)) + [value]
                rows.append(cells)
            yield named.get(place, f"sheet{number}"), rows


def spreadsheetml_sheets(text: str):
    """(name, rows of text) of each sheet of an XML spreadsheet; bare ampersands are repaired, gaps by index filled."""
    text = re.sub(BARE_AMPERSAND, "&amp;", text.lstrip("\ufeff \r\n\t"))
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise NavFileError(f"no XML spreadsheet: {e}") from None
    for sheet in (e for e in root.iter() if local(e) == "Worksheet"):
        rows, name = [], next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "Name"), "")
        for row in (e for e in sheet.iter() if local(e) == "Row"):
            cells: list = []
            for cell in (e for e in row if local(e) == "Cell"):
                index = next((int(v) for k, v in cell.attrib.items() if k.rpartition("}")[2] == "Index"), None)
                if index is not None:
                    cells += [""] * (index - 1 - len(cells))
                cells.append("".join(t for d in cell if local(d) == "Data" for t in d.itertext()).strip())
            rows.append(cells)
        yield name, rows


def csv_sheets(text: str):
    import csv

    yield "", list(csv.reader(text.lstrip("\ufeff").splitlines()))


def file_rows(content: bytes, kind: str, only: str | None = None):
    """(header, rows) of the first table with the expected header, on any sheet or on the one named ``only``."""
    if kind == "xlsx":
        sheets = xlsx_sheets(content)
    elif kind == "spreadsheetml":
        sheets = spreadsheetml_sheets(content.decode("utf-8-sig", "replace"))
    elif kind == "csv":
        sheets = csv_sheets(content.decode("utf-8-sig", "replace"))
    else:
        raise NavFileError(f"a web page or unknown markup instead of data ({kind})")
    for name, rows in sheets:
        if only not in (None, name):
            continue
        if found := table_rows(rows):
            return [plain_header(c) for c in found[0]], found[1]
    raise NavFileError("no row names both a date and a value column")


def read_nav_files(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """(path, row, raw_date, raw_nav) of all files; one file is one task's unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select("path", "content", sniff_format(F.col("content")).alias("kind"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not content.strip():
                    raise NavFileError(f"{name}: empty file")
                header, rows = file_rows(content, kind)
                pick = {}
                for what, names in (("date", DATE_NAMES), ("nav", NAV_NAMES)):
                    at = [i for i, h in enumerate(header) if h in names]
                    if len(at) != 1:
                        raise NavFileError(f"{name}: {len(at)} columns for {what}")
                    pick[what] = at[0]
                if not rows:
                    raise NavFileError(f"{name}: no rows below the header")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([r[pick["date"]] for r in rows]), pa.array([r[pick["nav"]] for r in rows])], ["path", "row", "raw_date", "raw_nav"])

    return files.mapInArrow(run, "path string, row long, raw_date string, raw_nav string")


def choose_files(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, path): for each key the file whose suffix comes first."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SUFFIXES)), F.regexp_extract("path", r"\.(\w+)$", 1))
    files = spark.read.format("binaryFile").load(path).select("path").withColumn("ticker", F.upper(F.regexp_extract("path", r"([^/]+)\.\w+$", 1))).withColumn("rank", rank).where("rank > 0")
    return files.groupBy("ticker").agg(F.min_by("path", "rank").alias("path"))


def nav_series(raw: DataFrame, min_rows: int = 1000, low: float = 1.0, high: float = 10_000.0) -> DataFrame:
    """(ticker, date, nav) after the guards, in this order: parse ratio, duplicates, rows, positive, range."""
    rows = raw.select(F.upper(F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).alias("ticker"), T.mixed_date(F.col("raw_date")).alias("date"), T.number(F.col("raw_nav")).alias("nav"))
    good = F.col("date").isNotNull() & F.col("nav").isNotNull()
    report = rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.count_if(good).alias("parsed"), F.count_distinct(F.when(good, F.col("date"))).alias("dates"),
        F.count_if(good & (F.col("nav") <= 0)).alias("not_positive"), F.count_if(good & ~F.col("nav").between(low, high)).alias("out_of_range"),
    )
    problem = (
        F.when(F.col("parsed") < 0.5 * F.col("n"), "fewer than half of the rows could be parsed")
        .when(F.col("dates") < F.col("parsed"), "duplicate dates")
        .when(F.col("parsed") < min_rows, f"fewer than {min_rows} rows")
        .when(F.col("not_positive") > 0, "values that are not positive")
        .when(F.col("out_of_range") > 0, "values outside the plausible range")
    )
    bad = report.withColumn("problem", problem).where("problem IS NOT NULL").limit(5).collect()
    if bad:
        raise NavFileError("; ".join(f"{r.ticker}: {r.problem}" for r in bad))
    if report.isEmpty():
        raise NavFileError("no rows at all")
    return rows.where(good)


def load_nav_file(spark: SparkSession, path: str, min_rows: int = 1000) -> DataFrame:
    """(ticker, date, nav) of one file, or of the file that is chosen for each key of a folder; refuses what fails a guard."""
    try:
        chosen = [r.path for r in choose_files(spark, path).collect()]  # a name a key
    except AnalysisException:
        chosen = []
    if not chosen:
        raise NavFileError(f"{path}: no file of published values; issuers offer them for download by hand")
    return nav_series(read_nav_files(spark, chosen), min_rows)


def ex_dates(spark: SparkSession, path: str, sheet_column: str = "ex-dividends", sheet: str | None = "Historical") -> DataFrame:
    """(ticker, date): dates of a workbook's rows, on the sheet of that name, whose dividend column is not blank."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                header, rows = file_rows(content, kind, None if kind == "csv" else sheet)
                if sheet_column in header:
                    d, x = next(i for i, h in enumerate(header) if h in DATE_NAMES), header.index(sheet_column)
                    days = [r[d] for r in rows if r[x].strip() not in ("", "-", "--")]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(days)), pa.array(days, pa.string())], ["path", "raw_date"])

    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", "content", sniff_format(F.col("content")).alias("kind")).mapInArrow(run, "path string, raw_date string")
    return found.select(F.upper(F.regexp_extract("path", r"([^/]+)\.\w+$", 1)).alias("ticker"), T.mixed_date(F.col("raw_date")).alias("date"))
