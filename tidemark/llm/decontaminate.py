"""Benchmark decontamination with Wu-Manber search over words.

A window is ``window`` consecutive words of an item, or all words of a shorter item.  For windows
of each length a shift table over hashed pairs of words says how far a search may move on; where
it says zero, windows with that last pair are looked up by its hash and compared word by word,
first by word hash, then by their bytes.  Searches advance through many stretches of text at once.

The items go to the driver in blocks of at most ``block_bytes`` of text, each of them broadcast
and searched for in all documents; nothing is shuffled.  Null texts and items without words have
no windows; a null item id is written as an empty string.  Rows that repeat an item or a document
count each by itself.  Other columns are ignored.  An empty table on either side is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Words, ranges, row_chunks, scramble, text_chunks

TABLE = 1 << 16


def item_windows(items: list, window: int) -> dict:
    """By length: (word hashes of each distinct window, its bytes, positions in ``items``)."""
    import numpy as np

    words = Words("alnum", 1 << 16)
    found: dict = {}
    for k, (_, text) in enumerate(items):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        starts, ends, low = words.find(offsets, raw)
        h = words.hashes(starts, ends, low)
        m = min(window, len(h))
        for i in range(len(h) - m + 1 if m else 0):
            body = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + m], ends[i : i + m]))
            found.setdefault(m, {}).setdefault(body, (h[i : i + m], set()))[1].add(k)
    out = {}
    for m, x in found.items():
        order = sorted(x, key=lambda b: int(_last(x[b][0])))
        hashes = np.stack([x[b][0] for b in order])
        out[m] = (hashes, order, [sorted(x[b][1]) for b in order])
    return out


def _last(h):
    """Hash of the last block (two words, or the only one) of windows or of one window."""
    import numpy as np

    with np.errstate(over="ignore"):
        last = h[..., -1]
        return scramble(last * np.uint64(3) + h[..., -2]) if h.shape[-1] > 1 else scramble(np.atleast_1d(last))[0] if h.ndim == 1 else scramble(last)


def shift_table(hashes):
    """For each slot of hashed blocks: the least distance to the end of a window that holds it."""
    import numpy as np

    m = hashes.shape[1]
    width = min(2, m)
    shift = np.full(TABLE, m - width + 1, np.int64)
    for j in range(width - 1, m):
        slot = (_last(hashes[:, j - width + 1 : j + 1]) % np.uint64(TABLE)).astype(np.int64)
        np.minimum.at(shift, slot, m - 1 - j)
    return shift


def search(h, first, hashes, shift, stretch: int = 512):
    """(end position, window) of all occurrences; ``first`` parts the words by text."""
    import numpy as np

    m = hashes.shape[1]
    if len(h) < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = np.zeros(len(h), np.uint64)
    if m > 1:
        blocks[1:] = scramble(h[1:] * np.uint64(3) + h[:-1])
    else:
        blocks = scramble(h)
    slot = (blocks % np.uint64(TABLE)).astype(np.int64)
    a, b = first[:-1] + m - 1, first[1:]
    room = np.maximum(b - a, 0)
    many = -(-room // stretch)
    text = np.repeat(np.arange(len(a)), many)
    at = np.repeat(a, many) + ranges(np.zeros(len(a), np.int64), many) * stretch
    end = np.minimum(at + stretch, b[text])
    suffix = _last(hashes)
    hits, which = [], []
    while len(at):
        move = shift[slot[at]]
        stop = at[move == 0]
        if len(stop):
            lo, hi = np.searchsorted(suffix, blocks[stop], "left"), np.searchsorted(suffix, blocks[stop], "right")
            size = hi - lo
            cand, pos = ranges(lo, size), np.repeat(stop, size)
            same = np.ones(len(cand), bool)
            for j in range(m):
                same &= hashes[cand, j] == h[pos - m + 1 + j]
            hits.append(pos[same])
            which.append(cand[same])
        at = at + np.maximum(move, 1)
        live = at < end
        at, end = at[live], end[live]
    return (np.concatenate(hits), np.concatenate(which)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(shared, last: bool):
    """Arrow mapper: (id, text, spans, items) with this block's occurrences added."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        windows, names = shared.value
        tables = {m: shift_table(x[0]) for m, x in windows.items()}
        words = Words("alnum")
        for batch in row_chunks(batches, 1):
            row = 0
            spans_in, items_in = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for ids, offsets, data in text_chunks([batch]):
                starts, ends, low = words.find(offsets, data)
                first = words.per_text(offsets, starts)
                h = words.hashes(starts, ends, low)
                spans = [list(spans_in[row + i] or ()) for i in range(len(ids))]
                items = [set(items_in[row + i] or ()) for i in range(len(ids))]
                for m, (hashes, bodies, owners) in windows.items():
                    pos, win = search(h, first, hashes, tables[m])
                    text = np.searchsorted(first, pos, "right") - 1
                    for p, w, t in zip(pos.tolist(), win.tolist(), text.tolist()):
                        body = b" ".join(low[a:b].tobytes() for a, b in zip(starts[p - m + 1 : p + 1], ends[p - m + 1 : p + 1]))
                        if body == bodies[w]:
                            spans[t].append(int((p - m + 1 - first[t]) << 16 | m))
                            items[t].update(names[k] for k in owners[w])
                for i in range(len(ids)):
                    out.append((int(first[i + 1] - first[i]), spans[i], sorted(items[i])))
                row += len(ids)
            keys = batch.column(0)
            if not last:
                yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array([r[1] for r in out], pa.list_(pa.int64())), pa.array([r[2] for r in out], pa.list_(pa.string()))], ["doc_id", "text", "spans", "items"])
                continue
            hit = []
            for n, found, _ in out:
                flags = np.zeros(n + 1, np.int64)
                for s in set(found):
                    flags[s >> 16] += 1
                    flags[(s >> 16) + (s & 0xFFFF)] -= 1
                hit.append(int((np.cumsum(flags) > 0).sum()))
            digest = [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in out]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([r[0] for r in out], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(r[2]) for r in out], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def keeper(shared, text_at: int):
    """Arrow mapper: whole rows of documents; those without an occurrence stay."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waiting = []

        def texts():
            for batch in row_chunks(batches, text_at):
                waiting.append(batch)
                none = [pa.nulls(batch.num_rows, pa.list_(t)) for t in (pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at), *none], ["doc_id", "text", "spans", "items"])

        for out in scan(shared, True)(texts()):
            yield waiting.pop(0).filter(pa.array(~np.array(out.column(5).to_pylist(), bool)))

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The items, streamed to the driver in blocks of at most ``limit`` bytes (or one item)."""
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        more = len((r[1] or "").encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += more
    yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast((item_windows(block, window), [x[0] for x in block]))
        if after is None:
            return docs.mapInArrow(scan(shared, True), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
        docs = docs.mapInArrow(scan(shared, False), "doc_id long, text string, spans array<bigint>, items array<string>")
        block = after


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no window of an item; each row is judged by itself."""
    schema, text_at = documents.schema, documents.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast((item_windows(block, window), [x[0] for x in block]))
        documents = documents.mapInArrow(keeper(shared, text_at), schema)
    return documents
