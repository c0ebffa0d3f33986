"""Exact repeated-substring removal.

A byte goes if some ``length``-byte string that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.  Strings are judged on the input.

The plan has four steps, none of which gathers more than a bounded bucket in one task.

1. Winnowing deals every ``length``-byte string to one 32-byte anchor inside it, the same for equal
   strings.  Consecutive strings with one anchor make a run; runs that are equal as a whole are
   settled by their hashes.  Each task keeps one copy of a run that it meets more than once.
2. What is left are runs that share an anchor but differ elsewhere, the edges of copied regions.
   Their bytes are fetched.
3. Buckets of such runs are joined to one text; breadth-first backward extension on its
   Burrows-Wheeler transform derives common prefixes by increasing length and stops at ``length``.
   Suffixes that are still undivided start with equal strings.
4. Anchors with more than ``hot`` different runs are settled string by string with an aggregate
   that combines before the shuffle, so no such group meets in one task.

Null or empty texts stay as they are.  A null id sorts first.  Rows that repeat an id and its text
count as one document, and each gets its result; different texts of an id, or of no id, are documents
in order of their digests.  Texts of any length are worked through whole, in overlapping segments.
Other columns of the input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bucket_count, join_by_size, pack, shared_table, split_rows, stacked
from .textops import ranges, scramble, text_chunks

ANCHOR = 32
SEGMENT = 8 << 20


def anchors(data, offsets, length: int, k: int):
    """(text, start, count, anchor's hash) of the runs of strings that share an anchor."""
    import numpy as np

    u = np.uint64
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, u)]
    n = len(data)
    if n < length:
        return none
    v = data.astype(u)
    v = v[:-1] | (v[1:] << u(8))
    v = v[:-2] | (v[2:] << u(16))
    v = v[:-4] | (v[4:] << u(32))
    m = n - k + 1
    h = np.zeros(m, u)
    for i in range(0, k, 8):
        h += v[i : i + m] * u(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    h = scramble(h)
    w = length - k + 1
    least, size = h, 1
    while size * 2 <= w:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[: m - w + 1], least[w - size :][: m - w + 1])
    enters = h[w - 1 :] == least
    event = enters.copy()
    event[1:] |= least[1:] != least[:-1]
    event[0] = True
    heads = offsets[:-1]
    event[heads[heads < len(event)]] = True
    s0 = np.flatnonzero(event)
    s1 = np.r_[s0[1:] - 1, len(event) - 1]
    text = np.searchsorted(offsets, s0, "right") - 1
    s1 = np.minimum(s1, offsets[text + 1] - length)
    keep = s1 >= s0
    s0, s1, text = s0[keep], s1[keep], text[keep]
    return text, s0, s1 - s0 + 1, least[s0]


def find_runs(length: int, k: int, buckets: int):
    """Arrow mapper: documents to (kind, bucket, block); kind 1 holds repeats settled in the task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        held, size = [], 0

        def flush():
            h, ctx, doc, start, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(h):
                return
            # rows come in order of text and start; only ids can be out of order
            order = np.argsort(ctx, kind="stable") if (doc[1:] >= doc[:-1]).all() else np.lexsort((start, doc, ctx))
            h, ctx, doc, start, n = (x[order] for x in (h, ctx, doc, start, n))
            new = np.r_[True, ctx[1:] != ctx[:-1]]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = ~new & ((doc != doc[lead]) | (start != start[lead]))
            rows = [(0, *x) for x in split_rows((h[new] % np.uint64(buckets)).astype(np.int64), [(h[new] >> np.uint64(32)).astype(np.uint32), ctx[new], doc[new], start[new], n[new].astype(np.uint16)])]
            if late.any():
                d, a, c = merged(doc[late], start[late], n[late])
                rows += [(1, *x) for x in split_rows(d % buckets, [d, a, c])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "block"])

        for ids, offsets, data in text_chunks(batches):
            for lo in range(0, max(1, len(data)), SEGMENT):
                part, o, base = data, offsets, 0
                if len(ids) == 1 and len(data) > SEGMENT:  # a very long text, in overlapping parts
                    part, base = data[lo : lo + SEGMENT + length - 1], lo
                    o = np.array([0, len(part)])
                elif lo:
                    break
                text, s0, n, h = anchors(part, o, length, k)
                view = memoryview(np.ascontiguousarray(part))
                ctx = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(s0.tolist(), (s0 + n + length - 1).tolist())), np.uint64, len(s0))
                held.append((h, scramble(ctx + h), ids[text], s0 - o[text] + base, n))
                size += len(part)
            if size >= 64 << 20:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def merged(doc, start, n):
    """Joins ranges of starts that touch or overlap within a document."""
    import numpy as np

    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    reach = end.copy()
    # the running maximum restarts at each document: lift every document above the one before
    lift = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(doc)])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:] - 1, len(doc) - 1]] - start[at]


def settle_runs(table):
    """One bucket: which runs repeat an earlier equal run (late), which need their bytes (edges)."""
    import numpy as np
    import pyarrow as pa

    kind = table.column("kind").to_numpy()
    blocks = table.column("block").to_pylist()
    h, ctx, doc, start, n = stacked([b for b, k in zip(blocks, kind) if k == 0], 5, [np.uint32, np.uint64, np.int64, np.int64, np.uint16])
    d1, a1, n1 = stacked([b for b, k in zip(blocks, kind) if k == 1], 3, [np.int64] * 3)
    order = np.lexsort((start, doc, ctx, h))
    h, ctx, doc, start, n = (x[order] for x in (h, ctx, doc, start, n.astype(np.int64)))
    if len(h):
        new = np.r_[True, (ctx[1:] != ctx[:-1]) | (h[1:] != h[:-1])]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = ~new & ((doc != doc[lead]) | (start != start[lead]))
        hn = h[new]
        twin = np.zeros(len(hn), bool)
        twin[1:] = hn[1:] == hn[:-1]
        twin[:-1] |= twin[1:]
        edge = np.flatnonzero(new)[twin]
    else:
        late, edge = np.zeros(0, bool), np.zeros(0, np.int64)
    ld, la, ln = merged(np.r_[doc[late], d1], np.r_[start[late], a1], np.r_[n[late], n1])
    bucket = int(table.column("bucket")[0].as_py()) if table.num_rows else 0
    group = (h[edge].astype(np.int64) << 24) + bucket
    return pa.table({"doc": np.r_[ld, doc[edge]], "start": np.r_[la, start[edge]], "n": np.r_[ln, n[edge]], "anchor": np.r_[np.full(len(ld), -1), group]}, schema=pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64())]))


def fetch_runs(length: int, buckets: int):
    """Arrow mapper: (doc, text, runs) to packed runs by bucket of their anchor."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, doc, start, n, anchor = [], [], [], [], []
            for d, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                for r in runs:
                    parts.append(raw[r["start"] : r["start"] + r["n"] + length - 1])
                    doc.append(d), start.append(r["start"]), n.append(r["n"]), anchor.append(r["anchor"])
            doc, start, n, anchor = (np.array(x, np.int64) for x in (doc, start, n, anchor))
            data = np.frombuffer(b"".join(parts), np.uint8)
            size = n + length - 1
            at = np.cumsum(size) - size
            rows = []
            where = scramble(anchor.astype(np.uint64)) % np.uint64(buckets)
            for b in np.unique(where):
                i = np.flatnonzero(where == b)
                rows.append((int(b), pack([doc[i], start[i], n[i].astype(np.uint16)]), pack([data[ranges(at[i], size[i])]])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "runs", "bytes"])

    return run


def suffix_order(symbols, depth: int):
    """Suffixes sorted by at least their first ``depth`` symbols (values below 512)."""
    import numpy as np

    n = len(symbols)
    wide = np.r_[symbols, np.zeros(7, np.uint16)].astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | wide[j : j + n]
    reach = 7
    while True:
        order = np.argsort(key)  # ties may stand in any order
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        if reach >= depth or (n and rank[order[-1]] == n - 1):
            return order
        after = np.zeros(n, np.int64)
        if reach < n:
            after[:-reach] = rank[reach:] + 1
        key = rank * (n + 1) + after
        reach *= 2


def common_prefix_classes(symbols, length: int):
    """(suffix order, class of each): suffixes of one class share their first ``length`` symbols.

    Symbol 0 parts the runs and is never prepended, so no prefix reaches over it.  Intervals of
    the transform are extended backwards level by level; an interval lives on only if it sets a
    boundary that no shorter prefix has set, so the whole work is bounded by the boundaries.
    """
    import numpy as np

    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]
    bwt[order == 0] = 0
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    first = symbols[order]
    head = np.ones(n + 1, bool)
    head[1:n] = first[1:] != first[:-1]
    bound = head.copy()
    lo = np.flatnonzero(head[:n])
    hi = np.r_[lo[1:], n]
    owner = np.full(n + 2, -1, np.int64)
    base = 0
    for _ in range(1, length):
        size = hi - lo
        i = ranges(lo, size)
        who = np.repeat(np.arange(base, base + len(lo)), size)
        base += len(lo)
        real = bwt[i] != 0
        to = step[i[real]]
        owner[to + 1] = who[real]
        mine = owner[to + 1]
        ends = np.sort(to[(owner[to + 2] != mine) | head[to + 1]]) + 1
        starts = np.sort(to[(owner[to] != mine) | head[to]])
        fresh = ~bound[ends]
        lo, hi = starts[fresh], ends[fresh]
        bound[hi] = True
        if not len(lo):
            break
    return order, np.cumsum(bound[:n])


def settle_edges(length: int):
    """Group function: of the strings in one bucket of runs, those that start earlier in another."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        doc, start, n = stacked(table.column("runs").to_pylist(), 3, [np.int64, np.int64, np.uint16])
        (data,) = stacked(table.column("bytes").to_pylist(), 1, [np.uint8])
        n = n.astype(np.int64)
        size = n + length
        at = np.cumsum(size) - size
        symbols = np.zeros(int(size.sum()), np.uint16)
        symbols[ranges(at, size - 1)] = data.astype(np.uint16) + 1
        order, group = common_prefix_classes(symbols, length)
        group_of = np.empty(len(order), np.int64)
        group_of[order] = group
        g = group_of[ranges(at, n)]
        run = np.repeat(np.arange(len(n)), n)
        where = ranges(start, n)
        by = np.lexsort((where, doc[run], g))
        g, d, where = g[by], doc[run][by], where[by]
        new = np.r_[True, g[1:] != g[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = ~new & ((d != d[lead]) | (where != where[lead]))
        d, a, c = merged(d[late], where[late], np.ones(int(late.sum()), np.int64))
        return pa.table({"doc": d, "start": a, "n": c})

    return run


def single_strings(length: int):
    """Arrow mapper for hot anchors: one row for each string of each run."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for d, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                at = sorted({s for r in runs for s in range(r["start"], r["start"] + r["n"])})
                for lo in range(0, len(at), 100_000):
                    some = at[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(raw[s : s + length]) for s in some], pa.binary()), pa.array([d] * len(some), pa.int64()), pa.array(np.array(some, np.int64))], ["string", "doc", "start"])

    return run


def drop_spans(length: int, texts: bool):
    """Arrow mapper: (id, text, packed ranges) to the result row of each document."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts
        for batch in batches:
            rows = []
            for d, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode()
                gone = count = 0
                kept = raw
                if spans:
                    s = np.sort(np.array(spans, np.int64))
                    a = s >> 24
                    b = np.maximum.accumulate(a + (s & 0xFFFFFF) + length - 1)
                    new = np.r_[True, a[1:] > b[:-1]]
                    a, b = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    gone, count = len(raw) - len(kept), len(a)
                rows.append((None if d == NULL_ID else d, len(raw), gone, count, hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace") if text is not None else None,) if texts else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    return run


def repeated_ranges(docs: DataFrame, length: int = 100, hot: int = 50_000) -> DataFrame:
    """(doc, start, n): ranges of start offsets whose ``length``-byte strings also start earlier."""
    k = min(ANCHOR, length // 2 // 8 * 8)
    if k < 8:
        raise ValueError("length must be at least 16 bytes")
    buckets = bucket_count(docs, 8 << 20)
    found = docs.mapInArrow(find_runs(length, k, buckets), "kind int, bucket int, block binary")
    runs = shared_table(found.groupBy("bucket").applyInArrow(settle_runs, "doc long, start long, n long, anchor long"))
    late = runs.where("anchor = -1").select("doc", "start", "n")
    edges = runs.where("anchor <> -1")
    total = edges.agg(F.count("*"), F.sum("n")).first()
    if not total[0]:
        return late
    crowd = edges.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total[1] + total[0] * length) // (3 << 20))

    def with_text(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("runs"))
        return docs.join(wanted.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "runs")

    hot_rows = crowd.limit(1).count()
    cold = edges.join(crowd, "anchor", "left_anti") if hot_rows else edges
    fetched = with_text(cold).mapInArrow(fetch_runs(length, parts), "bucket int, runs binary, bytes binary")
    out = late.union(fetched.groupBy("bucket").applyInArrow(settle_edges(length), "doc long, start long, n long"))
    if hot_rows:
        strings = shared_table(with_text(edges.join(crowd, "anchor", "left_semi")).mapInArrow(single_strings(length), "string binary, doc long, start long"))
        first = strings.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("first"))
        again = strings.join(first, "string").where("first.doc <> doc or first.start <> start")
        out = out.union(again.select("doc", "start", F.lit(1).cast("long").alias("n")))
    return out


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, texts: bool = False, hot: int = 50_000) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text on request)."""
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    digest, names = F.md5(F.coalesce("text", F.lit("")).cast("binary")), None
    checked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    if checked.where("a <> b").limit(1).count():  # ids with several texts: a number for each, in order
        names = docs.select(F.col("doc_id").alias("id"), digest.alias("digest")).distinct().orderBy("id", "digest")
        names = shared_table(names.withColumn("key", F.monotonically_increasing_id()))
        docs = shared_table(docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), "text").join(names, ["id", "digest"]).select(F.col("key").alias("doc_id"), "text"))
    found = repeated_ranges(docs, length, hot)
    pieces = found.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / (1 << 23)).cast("long"))).alias("i"), "start", "n")
    piece = (F.shiftleft(F.col("start") + F.col("i") * (1 << 23), 24) + F.least(F.col("n") - F.col("i") * (1 << 23), F.lit(1 << 23))).alias("span")
    spans = pieces.select("doc", piece).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    both = docs.join(spans.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(drop_spans(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)
    if names is None:
        return out
    own = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return out.join(names, F.col("doc_id") == F.col("key")).select(own, *out.columns[1:])
