import hashlib
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm.warc import MAGIC, encoded, parts_of, reachable, read_archives, write_archives


def test_round_trip_and_traps(spark):
    trap = "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/ b", "x" * 120), (5, "u", "x" * 120), (3, None, trap), (9, "u\r\nX: y", trap), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest").repartition(2)
    got = {r.page_id: tuple(r)[1:] for r in read_archives(spark, write_archives(df)).collect()}
    want = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        first = min(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(raw) >= 100 and p != first
        want[p] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)
    assert got == want


def test_null_page_and_empty(spark):
    df = spark.createDataFrame([(None, "u", "y" * 200), (2, "u", "y" * 200)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in read_archives(spark, write_archives(df)).collect())
    assert got == [(0, "response", None), (2, "revisit", None)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(spark, write_archives(none)).collect() == []


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "300")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_records_across_ranges(spark, small_ranges, monkeypatch, rows):
    """Ranges of 300 bytes: records and traps lie across many of them, and whole ranges lie inside a record."""
    monkeypatch.setattr("tidemark.llm.warc.BROADCAST_ROWS", rows)
    r = np.random.default_rng(4)
    bits = ["WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "WARC/1.1\r\n", "WARC/1.", "\r\n\r\n", "é", "a b c " * 30, "WARC/1.0\r\nContent-Length: 9999\r\n\r\n"]
    pages = [(i, "u", "".join(bits[k] for k in r.integers(0, len(bits), r.integers(0, 30)))) for i in range(60)]
    pages.append((99, "u", "z" * 20_000))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: tuple(x)[1:] for x in read_archives(spark, write_archives(df, least=10**9)).collect()}
    assert got == {p: (len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response", None) for p, _, h in pages}


def test_very_long_payload(spark):
    html = "WARC/1.1\r\n" * 400_000 + "é" * 3_000_000
    df = spark.createDataFrame([(1, "u", html), (2, "u", "x")], "page_id long, url string, html string")
    got = {x.page_id: (x.payload_bytes, x.payload_digest) for x in read_archives(spark, write_archives(df)).collect()}
    assert got == {p: (len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for p, h in ((1, html), (2, "x"))}


def test_urls_and_many_files(spark):
    df = spark.createDataFrame([(1, "http://a/\tb\x01c d\r\ne\x7f\x00", "x")], "page_id long, url string, html string")
    assert df.select(encoded(F.col("url"))).first()[0] == "http://a/%09b%01c%20d%0D%0Ae%7F%00"
    some = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id % 7, repeat('-', 200)) AS html").repartition(2)
    path = write_archives(some, records_per_file=3)
    assert len(list(Path(path.removeprefix("file:")).glob("*.txt"))) >= 16
    got = read_archives(spark, path).collect()
    assert sorted(x.page_id for x in got) == list(range(50)) and sum(x.record_type == "response" for x in got) == 7


def test_broken_chain(spark, tmp_path):
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert parts_of(one[len(MAGIC):]) == (len(one) - 7, 3) and parts_of(b"1\r\nno length\r\n\r\n") is None and parts_of(b"1\r\nContent-Length: 3") is None and parts_of(b"2\r\n") is None
    n = len(one)
    assert reachable([0, n, 2 * n], [n, 2 * n, 3 * n], 3 * n).all()
    with pytest.raises(ValueError):
        reachable([0, n], [n + 1, 2 * n], 2 * n)
    assert list(np.flatnonzero(reachable([0, 10, 20], [20, 15, 30], 30))) == [0, 2]
    for k, bad in enumerate((b"junk", b"junk" + one, one + b"junk", one[:-1], one.replace(b": 3", b": 4"))):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.txt").write_bytes(bad)
        with pytest.raises(Exception, match="chain"):
            read_archives(spark, str(tmp_path / str(k))).collect()
