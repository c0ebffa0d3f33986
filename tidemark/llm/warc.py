"""WARC archives: written by Spark, read back with a check of the record chain.

Writing: of records with equal payloads of at least ``least`` bytes the smallest page_id is the
response and the others are revisits without payload.  Payload digests are compared first; only
the (page_id, digest) rows are shuffled, never the pages, unless there are more copies than may be
broadcast.  Records are UTF-8 text, so the text writer emits them, with the CR LF CR LF that ends a
record as its separator.

Reading: files are read by byte ranges, cut at each place that could start a record.

1. A task finds, for each such place of its ranges, the successor that the header's length asks for.
2. Per file, these offsets (16 bytes for each place, no contents) are put together, and pointer jumping
   from the file's start tells which are reached; each range learns the first that matters to it.
3. The ranges are read again.  A task follows the chain, so a header inside a payload is part of the
   payload, and verifies each record; what lies across ranges is put together by its record.

A chain that does not end at the file's end, or a payload that does not match its digest, is an
error.  Only one record is held at a time, so neither the length of files nor that of texts matters.

A null page_id is kept and sorts first; rows that repeat a page_id with one payload are all
responses if it is the smallest.  Null html is an empty payload, a null url an empty one; control
characters and spaces of a url are percent-encoded.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NULL_ID, join_by_size, shared_dir, shared_table

END = "\r\n"
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
DATE = "2024-01-01T00:00:00Z"
#: What each record starts with, but for the minor version.
MAGIC = "WARC/1."
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def encoded(url):
    """Control characters and spaces by their own codes."""
    each = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}")), [*range(0x21), 0x7F], url)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), each).otherwise(url)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, records_per_file: int = 1_000_000) -> str:
    """Writes the records below the shared folder; returns the archives' folder."""
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    keys = rows.where(F.octet_length("html") >= least).select("page", digest.alias("digest"))
    first = shared_table(keys.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last").select("digest", "first"))
    rows = join_by_size(rows.withColumn("digest", digest), first, "digest", "left", 128)
    again = (F.col("page") > F.col("first")) & (F.octet_length("html") >= least)
    again = F.coalesce(again, F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), encoded(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.octet_length("html").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP)) + F.when(again, 0).otherwise(F.octet_length("html"))).cast("string")),
    ]
    record = F.concat(F.concat_ws(END, *fields), F.lit(END + END + HTTP), F.when(again, F.lit("")).otherwise(F.col("html")))
    path = shared_dir(pages.sparkSession)
    rows.select(record.alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parts_of(line: bytes):
    """(length of the header, length of the content) if what follows a magic may start a record, else None."""
    import re

    if line[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    stop = line.find(b"\r\n\r\n", 1)
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", line[: stop + 2]) if stop >= 0 else None
    return (len(MAGIC) + stop + 4, int(size[1])) if size else None


def reachable(offsets, after, end: int):
    """Flags of the candidates that the chain from offset 0 visits; doubles the jumps each round."""
    import numpy as np

    n = len(offsets)
    offsets = np.asarray(offsets, np.int64)
    after = np.asarray(after, np.int64)
    at = np.searchsorted(offsets, after)
    known = (at < n) & (offsets[np.minimum(at, n - 1)] == after) if n else np.zeros(0, bool)
    jump = np.r_[np.where(known, at, np.where(after == end, n, n + 1)), n, n + 1]  # n: the end, n + 1: astray
    seen = np.zeros(n + 2, bool)
    if n and offsets[0] == 0:
        seen[0] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        jump2 = jump[jump]
        if (more == seen).all() and (jump2 == jump).all():
            break
        seen, jump = more, jump2
    if seen[n + 1] or end and not seen[n]:
        raise ValueError("the record chain breaks off before the end of the archive")
    return seen[:n]


def ranges_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, start, line): what lies between two magics, in order within each byte range of a file."""
    lines = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def successors(batches):
    """Arrow mapper: one row for each byte range: its bytes, and places and successors from its first line on."""
    import numpy as np
    import pyarrow as pa

    key, place, found = None, 0, []

    def row():
        at, after = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, place, at, after), kinds)], ["file", "size", "start", "bytes", "places", "after"])

    for batch in batches:
        for file, size, start, line in zip(*(batch.column(i) for i in range(4))):
            now = (file.as_py(), size.as_py(), start.as_py())
            if now != key:
                if key is not None:
                    yield row()
                key, place, found = now, 0, []
            line = line.as_py()
            parts = parts_of(line) if place or key[2] else None  # no magic before a file's first line
            if parts:
                found.append((place - len(MAGIC), place - len(MAGIC) + sum(parts) + 4))
            place += len(line) + len(MAGIC)
    if key is not None:
        yield row()


def chain(table):
    """Group function over a file's ranges: where each begins, and the first record from there on that is reached."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("start")
    size = table.column("size")[0].as_py()
    total = np.cumsum(table.column("bytes").to_numpy())
    base = np.r_[0, total[:-1]]
    if total[-1] - len(MAGIC) != size:
        raise ValueError("ranges of the archive are missing")
    whole = lambda c: np.concatenate([np.array(x.as_py(), np.int64) + b for x, b in zip(table.column(c), base)])
    places = whole("places")
    kept = np.r_[places[reachable(places, whole("after"), size)], size]
    entry = kept[np.searchsorted(kept, base - len(MAGIC))]
    return pa.table({"file": table.column("file"), "start": table.column("start"), "base": base, "entry": entry})


def verified(content: bytes):
    """The result row of one record, from its magic to the end of its content."""
    import hashlib

    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(END)[1:])
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    kind, size, digest = fields["WARC-Type"], int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number, refers = page(fields["WARC-Record-ID"]), page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 : int(fields["Content-Length"])]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {number} does not match its digest")
    return None if number == NULL_ID else number, size, digest, kind, None if refers == NULL_ID else refers


def follow(batches):
    """Arrow mapper: lines of byte ranges in order to verified records, and to pieces of those that lie across ranges.

    A piece is told apart by the place where its record's successor starts.
    """
    import pyarrow as pa

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("after", pa.int64()), ("place", pa.int64()), ("piece", pa.binary())]
    out: list = []
    held: list = []
    key, place, expected, first, begun = None, 0, 0, 0, False

    def rows():
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])
        out.clear()
        return made

    def close(whole: bool):
        if held:
            content = b"".join(held)
            out.append((*verified(content), None, None, None, None) if whole else (*[None] * 5, key[0], expected, first, content))
            held.clear()

    for batch in batches:
        for file, start, line, base, entry in zip(*(batch.column(i) for i in range(5))):
            if (file.as_py(), start.as_py()) != key:
                close(begun and expected == place - len(MAGIC))
                key, place = (file.as_py(), start.as_py()), base.as_py()
                expected, begun = entry.as_py(), False  # up to the entry, lines belong to a record of an earlier range
            line, here = line.as_py(), place - len(MAGIC)
            if here == expected:
                close(begun)
                expected, begun = here + sum(parts_of(line)) + 4, True
            if here >= 0:  # else it is what precedes a file's first magic: nothing
                first = first if held else here
                held += [MAGIC.encode(), line]
            place += len(line) + len(MAGIC)
            if len(out) >= 1000:
                yield rows()
    close(begun and expected == place - len(MAGIC))
    if out:
        yield rows()


def assemble(table):
    """Group function over the pieces of one record: its result row."""
    import pyarrow as pa

    row = verified(b"".join(table.sort_by("place").column("piece").to_pylist()))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in RESULT.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    lines = ranges_of(spark, path)
    found = shared_table(lines.mapInArrow(successors, "file string, size long, start long, bytes long, places array<long>, after array<long>"))
    entries = shared_table(found.groupBy("file").applyInArrow(chain, "file string, start long, base long, entry long"))
    if entries.count() <= BROADCAST_ROWS:  # a row for each byte range
        both = lines.join(F.broadcast(entries), ["file", "start"])
    else:
        both = lines.withColumn("line_number", F.monotonically_increasing_id()).join(entries.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "line_number")
    made = shared_table(both.select("file", "start", "line", "base", "entry").mapInArrow(follow, f"{RESULT}, file string, after long, place long, piece binary"))
    whole = made.where("piece IS NULL").select(*(c.split()[0] for c in RESULT.split(", ")))
    return whole.union(made.where("piece IS NOT NULL").groupBy("file", "after").applyInArrow(assemble, RESULT))
