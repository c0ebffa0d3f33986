"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity of ``num / den``.

Shingles are ordered from rare to common, then by hash.  Two similar sets share an element of their
prefixes in that order, so only prefix elements are joined:

1. Documents with equal prefixes and equal size make one group; the groups' prefix elements are
   dealt to buckets by their hash.
2. Of the groups that hold an element, two stay a pair if the smaller size is not too small and, from
   the element on, both have as many elements left as similar sets of their sizes must share.  What
   such pairs hold together is named by the group whose element comes first, so every pair of groups
   that passes the filter carries a common name.  A group that passes with some group of a size passes
   with the one of that size that has most elements left, so only those are tried.
3. Names are expanded to member documents, whose pairs are filtered by bit sketches of their sets:
   similar sets differ in a bounded number of elements, and so in as many bits at most.
   Documents without a partner drop out; what holds together, under any names, makes a block, so
   that each set is sent once.
4. The sets of the documents that are left are compared exactly, block by block: a
   block's intersection sizes are one product of 0/1 matrices.  Only a spanning forest leaves a
   block.  Blocks of more than ``block`` members are cut, and each part also gets the member whose
   elements led most lists; documents that have not joined the main component of their block are
   then compared with the rest of it, tile by tile: by sketches first, and by their sets where those
   allow a link.

No task holds more than a few blocks or one tile.  The second pass writes a row for each document that is
left and each tile of ``TILE`` documents of its block, and the reverse; that is little where a block has a
main component, and the square of the block's size over ``TILE`` where it has none, as any exact comparison
of a crowd of unlike documents that share their rarest shingles.  Sets are compared by 64-bit shingle
hashes.  Copies of one set are collapsed before the comparison.

A null or empty text has no shingles and links with nothing.  Each row with a null id, and each further
row of an id, is a document of its own; null ids sort first.  Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bucket_count, components, fresh, join_by_size, pack, release, shared_table, smallest_reachable, split_rows, stacked, unpack
from .textops import Words, chain, ranges, row_chunks, scramble, text_chunks, trim

SLOTS = 1 << 22
#: Bits of a sketch for each element, at least; sketches have a power of two of bits.
BITS = 2
#: Names with more documents than this are not filtered in one task but kept together, and cut later.
FILTERED = 4096
#: Documents of a tile in the second pass.
TILE = 2048
#: Rows without an id have keys of their own, from NULL_ID on and below this; further rows of an id from here on.
NULL_KEYS, MORE_KEYS = NULL_ID + (1 << 56), 1 << 62


def shingle_sets(batches, width: int):
    """Yields (ids, offsets, sorted distinct shingle hashes) of each chunk of texts."""
    import numpy as np

    words = Words("space")
    for ids, offsets, data in text_chunks(batches):
        starts, ends, low = words.find(offsets, data)
        h = words.hashes(starts, ends, low)
        first = words.per_text(offsets, starts)
        count = np.diff(first)
        grams = chain(h, width)
        sizes = np.maximum(count - width + 1, 0)
        text = np.repeat(np.arange(len(ids)), sizes)
        items = grams[ranges(first[:-1], sizes)]
        for i in np.flatnonzero((count > 0) & (count < width)):  # the whole sequence is one shingle
            text = np.append(text, i)
            items = np.append(items, chain(h[first[i] : first[i + 1]], int(count[i])))
        order = np.lexsort((items, text))
        text, items = text[order], items[order]
        keep = np.r_[True, (text[1:] != text[:-1]) | (items[1:] != items[:-1])] if len(text) else np.zeros(0, bool)
        text, items = text[keep], items[keep]
        yield ids, np.searchsorted(text, np.arange(len(ids) + 1)), items


def slot_counts(width: int, parts: int):
    """Arrow mapper: how many texts of the task hold a shingle of each slot, by range of slots."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(SLOTS, np.uint32)
        for _, _, items in shingle_sets(batches, width):
            slot, times = np.unique((items >> np.uint64(42)).astype(np.uint32), return_counts=True)
            total[slot] += times.astype(np.uint32)
        if total.any():
            blocks = [pack([x]) for x in np.split(total, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    return run


def add_slots(table):
    """Group function: the sum of the counts of one range of slots."""
    import pyarrow as pa

    total = None
    for block in table.column("block"):
        (x,) = unpack(block.as_py())
        total = x.astype("int64") if total is None else total + x
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "block": pa.array([pack([total])], pa.binary())})


def common_slots(docs: DataFrame, width: int) -> bytes:
    """One bit for each slot that holds far more shingles than slots do on average (512 kB at any size)."""
    import numpy as np

    parts = 16
    rows = docs.mapInArrow(slot_counts(width, parts), "part int, block binary").groupBy("part").applyInArrow(add_slots, "part int, block binary").collect()
    if not rows:
        return pack([np.zeros(SLOTS // 8, np.uint8)])
    count = np.concatenate([unpack(r.block)[0] for r in sorted(rows, key=lambda r: r.part)])
    mean = count.mean()
    return pack([np.packbits(count > mean + 6 * mean**0.5 + 16)])


def prefixes(width: int, num: int, den: int, slots: bytes, buckets: int):
    """Arrow mapper: kind 1 blocks describe documents, kind 0 blocks hold groups' prefix elements."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        common = np.unpackbits(unpack(slots)[0]).astype(bool)
        for batch in row_chunks(batches, 1):
            info, entries = [], []
            for ids, first, items in shingle_sets([batch], width):
                n = np.diff(first)
                text = np.repeat(np.arange(len(ids)), n)
                hot = common[(items >> np.uint64(42)).astype(np.int64)]
                order = np.lexsort((items, hot, text))
                place = np.arange(len(items)) - first[text]
                items, hot = items[order], hot[order]
                mixed = scramble(items ^ np.uint64(0x5851F42D4C957F2D))
                total = lambda x: np.r_[np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]
                span = lambda c, b: c[b] - c[first[:-1]]
                size = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                a, b = total(mixed), total(items)
                sig = scramble(span(a, first[1:]) + n.astype(np.uint64))
                sig2 = scramble(span(b, first[1:]))
                group = scramble(span(a, first[:-1] + size) * np.uint64(31) + n.astype(np.uint64))
                place_of = mixed >> np.uint64(20)
                sketch, held = [], np.zeros(len(ids), np.int64)
                for i, (lo, k) in enumerate(zip(first[:-1].tolist(), n.tolist())):
                    width_of = max(64, 1 << (BITS * k - 1).bit_length()) if k else 0
                    bits = np.zeros(width_of, np.uint8)
                    bits[(place_of[lo : lo + k] & np.uint64(max(width_of - 1, 0))).astype(np.int64)] = 1
                    sketch.append(np.packbits(bits))
                    held[i] = width_of // 8
                info.append((ids, n, sig, sig2, group, held, np.concatenate(sketch)))
                _, one = np.unique(group[n > 0], return_index=True)
                one = np.flatnonzero(n > 0)[one]
                at = ranges(first[one], size[one])
                owner = np.repeat(one, size[one])
                entries.append((items[at], group[owner], n[owner], place[at]))
            if not info:
                continue
            rows = [(1, int(x[0][0]) % buckets, pack(list(x))) for x in info]
            item, g, size, place = (np.concatenate(x) for x in zip(*entries))
            order = np.argsort(item, kind="stable")
            item, g, size, place = (x[order] for x in (item, g, size, place))
            rows += [(0, *x) for x in split_rows((item % np.uint64(buckets)).astype(np.int64), [(item >> np.uint64(16)), g, size.astype(np.uint32), place.astype(np.uint32)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "block"])

    return run


def described(batches):
    """Arrow mapper: kind 1 blocks to one row for each document."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for block in batch.column("block"):
            ids, n, sig, sig2, group, held, raw = unpack(block.as_py())
            raw, ends = raw.tobytes(), np.cumsum(held).tolist()
            sketch = pa.array([raw[a:b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (ids, n, sig.view(np.int64), sig2.view(np.int64), group.view(np.int64))), sketch], ["doc", "n", "sig", "sig2", "grp", "sketch"])


def joined_lists(item, n, left, num: int, den: int):
    """Connected parts of each element's list under the group-pair filter; rows in order of item and n.

    ``left`` counts a group's elements from the shared one on.
    """
    import numpy as np

    need = lambda a, b: -(-num * (a + b) // (num + den))
    same = np.r_[False, (item[1:] == item[:-1]) & (n[1:] == n[:-1])]
    first = np.flatnonzero(~same)
    size_of = np.cumsum(~same) - 1  # by row: its run of one item and size
    most = np.maximum.reduceat(left, first)
    best = np.flatnonzero(left == most[size_of])
    best = best[np.searchsorted(size_of[best], np.arange(len(first)))]  # the row with most elements left, by run
    size, list_of = n[first], item[first]
    fits = np.minimum(left, most[size_of]) >= need(n, n)
    a, b = [np.flatnonzero(fits)], [best[size_of[fits]]]
    for way in (1, -1):
        row, step = np.arange(len(n)), 0
        while len(row):
            step += way
            run = size_of[row] + step
            ok = (run >= 0) & (run < len(first))
            row, run = row[ok], run[ok]
            ok = (list_of[run] == item[row]) & (np.minimum(size[run], n[row]) * den >= np.maximum(size[run], n[row]) * num)
            row, run = row[ok], run[ok]
            fits = np.minimum(left[row], most[run]) >= need(n[row], size[run])
            a.append(row[fits])
            b.append(best[run[fits]])
    return smallest_reachable(np.concatenate(a), np.concatenate(b), len(n))


def named_groups(num: int, den: int):
    """Group function: (name, group) of the groups that may be similar by one of the bucket's elements."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        item, g, n, place = stacked(table.column("block").to_pylist(), 4, [np.uint64, np.uint64, np.uint32, np.uint32])
        item, g = item.view(np.int64), g.view(np.int64)
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((g, n, item))
        item, g, n, place = (x[order] for x in (item, g, n, place))
        if len(item):
            keep = np.r_[True, (item[1:] != item[:-1]) | (g[1:] != g[:-1])]
            keep &= np.r_[False, item[1:] == item[:-1]] | np.r_[item[1:] == item[:-1], False]
            item, g, n, place = (x[keep] for x in (item, g, n, place))
        pairs = np.zeros((0, 2), np.int64)
        if len(item):
            label = joined_lists(item, n, n - place, num, den)
            many = np.bincount(label, minlength=len(label))[label] > 1
            label, g, place = label[many], g[many], place[many]
            order = np.lexsort((g, place, label))
            label, g = label[order], g[order]
            new = np.r_[True, label[1:] != label[:-1]] if len(label) else np.zeros(0, bool)
            name = g[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(label) else g
            pairs = np.unique(np.stack([name, g], 1), axis=0)
        return pa.table({"name": pairs[:, 0], "grp": pairs[:, 1]})

    return run


def plausible(n, sketches: list, num: int, den: int):
    """Square matrix: which pairs of sets their sizes and sketches allow to be similar."""
    import numpy as np

    wide = np.array([len(s) for s in sketches]) * 8
    out = np.zeros((len(n), len(n)), bool)

    def bits(i, width):
        x = np.unpackbits(np.frombuffer(b"".join(sketches[k] for k in i), np.uint8)).reshape(len(i), -1)
        return (x.reshape(len(i), -1, width).max(1) if x.shape[1] > width else x).astype(np.float32)

    for w in np.unique(wide):
        for v in (w, 2 * w):  # sizes that differ more than twofold are never similar
            left, right = np.flatnonzero(wide == w), np.flatnonzero(wide == v)
            rows = int(max(16, min(256, (1 << 22) // w)))
            for lo in range(0, len(left), rows):
                i = left[lo : lo + rows]
                x = bits(i, w)
                for at in range(0, len(right), 4 * rows):
                    j = right[at : at + 4 * rows]
                    y = bits(j, w)
                    a, b = n[i][:, None], n[j][None, :]
                    need = -(-num * (a + b) // (num + den))
                    both = x @ y.T
                    ok = (x.sum(1)[:, None] - both <= a - need) & (y.sum(1)[None, :] - both <= b - need)
                    out[np.ix_(i, j)] |= ok
                    out[np.ix_(j, i)] |= ok.T
    return out


def labels_of(near, rows: int = 256):
    """Smallest index that each index reaches through a symmetric boolean matrix."""
    import numpy as np

    label = np.arange(len(near))
    while True:
        low = label.copy()
        for lo in range(0, len(near), rows):
            part = near[lo : lo + rows]
            low[lo : lo + rows] = np.minimum(low[lo : lo + rows], np.where(part, low[None, :], len(near)).min(1))
        if (low == label).all():
            return label
        label = low


def filtered_pairs(num: int, den: int):
    """Group function over whole names: a spanning forest of the pairs of documents that may be similar."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        name, g, n = (table.column(c).to_numpy() for c in ("name", "doc", "n"))
        sketch = table.column("sketch").to_pylist()
        order = np.lexsort((g, name))
        cuts = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
        left, right = [], []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            i = order[lo:hi]
            label = labels_of(plausible(n[i], [sketch[k] for k in i], num, den))
            moved = np.flatnonzero(label != np.arange(len(i)))
            left.append(g[i[label[moved]]])
            right.append(g[i[moved]])
        trim()
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def open_pairs(num: int, den: int, most: int):
    """Group function over whole tiles: (block, doc) of the documents that may still gain a link, in blocks of at most ``most``."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        tile, doc, n, part = (table.column(c).to_numpy() for c in ("tile", "doc", "n", "component_id"))
        sketch = table.column("sketch").to_pylist()
        order = np.lexsort((doc, tile))
        cuts = np.flatnonzero(np.r_[True, tile[order][1:] != tile[order][:-1]])
        out = []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            i = order[lo:hi]
            i = i[np.r_[True, doc[i][1:] != doc[i][:-1]]]
            near = plausible(n[i], [sketch[k] for k in i], num, den) & (part[i][:, None] != part[i][None, :])
            label = labels_of(near)
            by = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.r_[True, label[by][1:] != label[by][:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)]):
                some = by[a:b]
                if 1 < len(some) <= most:
                    out.append((int(tile[i[0]]), a, 0, i[some]))
                elif len(some) > most:  # pieces in pairs, where any of their members may be linked
                    pieces = np.array_split(some, -(-2 * len(some) // most))
                    for x in range(len(pieces)):
                        for y in range(x, len(pieces)):
                            if near[np.ix_(pieces[x], pieces[y])].any():
                                out.append((int(tile[i[0]]), a, (x << 16 | y) + 1, i[np.union1d(pieces[x], pieces[y])]))
        trim()
        size = [len(x[3]) for x in out]
        names = [pa.array(np.repeat(np.array([x[k] for x in out], np.int64), size)) for k in range(3)]
        return pa.Table.from_arrays([*names, pa.array(doc[np.concatenate([x[3] for x in out])] if out else np.zeros(0, np.int64))], ["tile", "part", "piece", "doc"])

    return run


def member_sets(width: int):
    """Arrow mapper: (doc, text, blocks) to the packed set once for each block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            where = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            out, size = [], 0
            for ids, first, items in shingle_sets([batch], width):
                for i, d in enumerate(ids.tolist()):
                    block = items[first[i] : first[i + 1]].tobytes()
                    out += [(b, d, block) for b in where[d]]
                    size += len(block) * len(where[d])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "doc", "items"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "doc", "items"])

    return run


def similar_pairs(sets, num: int, den: int):
    """Square 0/1 matrix: which of the sets are similar enough."""
    import numpy as np

    n = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), n)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(item)
    shared = df[item] > 1
    who, item = who[shared], item[shared]
    _, item = np.unique(item, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(item, kind="stable")
    who, item = who[order], item[order]
    width = 4096
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, width):
        a, b = np.searchsorted(item, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(item[-1]) + 1 - lo)), np.float32)
        m[who[a:b], item[a:b] - lo] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    return den * both >= num * (n[:, None] + n[None, :] - both)


def compare_blocks(num: int, den: int):
    """Group function over whole blocks: a spanning forest of the similar pairs."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        block, doc = table.column("block").to_numpy(), table.column("doc").to_numpy()
        items = table.column("items").to_pylist()
        links = []
        order = np.lexsort((doc, block))
        cuts = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            i = order[lo:hi]
            i = i[np.r_[True, doc[i][1:] != doc[i][:-1]]]
            if len(i) < 2:
                continue
            label = labels_of(similar_pairs([np.frombuffer(items[k], np.uint64) for k in i], num, den))
            links += [(doc[i[k]], doc[i[r]]) for k, r in enumerate(label.tolist()) if k != r]
        trim()
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def compared(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the documents of each block; ``members``: (block, doc), lineage cut."""
    spark = docs.sparkSession
    wanted = shared_table(members.groupBy("doc").agg(F.collect_set("block").alias("blocks")).withColumnRenamed("doc", "doc_id"))
    both = join_by_size(docs, wanted, "doc_id", "inner", 128).select("doc_id", "text", "blocks")
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, members.count() // 2000)
    sets = both.mapInArrow(member_sets(width), "block long, doc long, items binary")
    return sets.groupBy(F.pmod(F.xxhash64("block"), F.lit(bins)).alias("bin")).applyInArrow(compare_blocks(num, den), "a long, b long")


def row_keys(documents: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows with a key of their own, and its name.

    The key is the id; a row without one has a key below NULL_KEYS, and each further row of an id one above MORE_KEYS.
    """
    name, key = fresh("row_key", documents), F.col(id_col).cast("long")
    again = shared_table(documents.where(key.isNotNull()).groupBy(key.alias(name)).count().where("count > 1").select(name))
    keyed = documents.withColumn(name, key)
    if not again.limit(1).count():
        rare, rest = keyed.where(key.isNull()), keyed.where(key.isNotNull())
        if rare.limit(1).count():
            rest = rest.unionByName(shared_table(rare.withColumn(name, F.monotonically_increasing_id() + NULL_ID)))  # written, so keys stay
        return rest, name
    place, least = fresh("place", keyed), fresh("least", keyed)
    rare = join_by_size(keyed, again, name, "left_semi").unionByName(keyed.where(key.isNull()))
    rare = shared_table(rare.withColumn(place, F.monotonically_increasing_id()))
    first = rare.groupBy(name).agg(F.min(place).alias(least))
    rare = join_by_size(rare, shared_table(first.where(F.col(name).isNotNull())), name, "left")
    own = F.when(key.isNull(), F.col(place) + NULL_ID).when(F.col(place) == F.col(least), key).otherwise(F.col(place) + MORE_KEYS)
    rest = join_by_size(keyed.where(key.isNotNull()), again, name, "left_anti")
    return rest.select(*documents.columns, name).unionByName(rare.withColumn(name, own).select(*documents.columns, name)), name


def linked(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, block: int = 256) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links; null ids come first)."""
    keyed, name = row_keys(documents.select(id_col, text_col), id_col)
    out = linked_keys(keyed, name, text_col, width, num, den, block)
    null = lambda c: F.when(F.col(c) >= NULL_KEYS, F.col(c)).alias(c)
    more = keyed.where(F.col(name) >= MORE_KEYS).select(F.col(name).alias("doc_id"), F.col(id_col).cast("long").alias("own"))
    if more.limit(1).count():  # further rows of an id: their keys say nothing of their place among the ids
        out = out.join(shared_table(more), "doc_id", "left").withColumn("doc_id", F.coalesce("own", "doc_id")).drop("own")
        least = shared_table(out.groupBy("component_id").agg(F.min("doc_id").alias("least")).where("least <> component_id"))
        out = join_by_size(out, least, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return out.select(null("doc_id"), "n_shingles", null("component_id"))


def linked_keys(documents: DataFrame, key_col: str, text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, block: int = 256) -> DataFrame:
    """As ``linked``, by a key without nulls that no two rows share."""
    docs = documents.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))
    slots = common_slots(docs, width)
    buckets = bucket_count(docs, 8 << 20)
    made = shared_table(docs.mapInArrow(prefixes(width, num, den, slots, buckets), "kind int, bucket int, block binary"))
    info = shared_table(made.where("kind = 1").mapInArrow(described, "doc long, n long, sig long, sig2 long, grp long, sketch binary"))
    sets = shared_table(info.where("n > 0").groupBy("n", "sig", "sig2", "grp").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch")))
    names = shared_table(made.where("kind = 0").groupBy("bucket").applyInArrow(named_groups(num, den), "name long, grp long").distinct())
    release(made)
    alone = sets.groupBy("grp").count().where("count > 1").select(F.col("grp").alias("name"), "grp")
    pairs = shared_table(names.union(alone).distinct().join(sets.select("grp", "doc"), "grp").select("name", "doc"))
    crowd = pairs.groupBy("name").agg(F.count("*").alias("many"), F.min("doc").alias("head")).where(F.col("many") > FILTERED)
    crowd = shared_table(crowd.select("name", "head"))
    bins = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    few = join_by_size(pairs, crowd.select("name"), "name", "left_anti").join(sets.select("doc", "n", "sketch"), "doc")
    may = few.groupBy(F.pmod(F.xxhash64("name"), F.lit(bins)).alias("bin")).applyInArrow(filtered_pairs(num, den), "a long, b long")
    many = join_by_size(pairs, crowd, "name", "inner").where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    may = may.union(many)
    blocks = components(may).select(F.col("id").alias("doc"), F.col("component_id").alias("name"))
    lists = names.groupBy(F.col("name").alias("grp")).agg(F.count("*").alias("lists"))
    named = sets.join(lists, "grp", "left").join(blocks, "doc").select("name", "doc", F.coalesce("lists", F.lit(0).cast("long")).alias("lists"))
    named = shared_table(named)
    release(names, pairs, crowd)
    sizes = named.groupBy("name").agg(F.count("*").alias("many"), F.max_by("doc", F.struct("lists", "doc")).alias("head")).where("many > 1")
    cut = F.ceil(F.col("many") / block).cast("long")
    parted = named.select("name", "doc").join(sizes.select("name", "head", cut.alias("cut")), "name").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("cut")))
    parted = shared_table(parted)
    release(named)
    heads = parted.where("doc = head and cut > 1").select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("part"), "doc")
    first = parted.select("name", "part", "doc").union(heads).distinct()
    links = shared_table(compared(docs, shared_table(first.select(F.xxhash64("name", "part").alias("block"), "doc")), width, num, den))
    big = parted.where("cut > 1")
    if big.limit(1).count():
        now = components(links)
        at = big.join(now.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
        at = shared_table(at.select("name", "doc", "component_id"))
        held = at.groupBy("name", "component_id").count().groupBy("name").agg(F.max_by("component_id", F.struct("count", "component_id")).alias("main"), F.sum("count").alias("all"))
        rest = at.join(held, "name").where("component_id <> main")
        some = rest.groupBy("name").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"), F.ceil(F.any_value("all") / TILE).cast("long").alias("cut"))
        some = shared_table(some)
        tile = lambda seed, c: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(c))
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        spread = join_by_size(rest, some, "name", "inner").withColumn("row", tile(7, "tiles")).select("name", "row", each("cut").alias("col"), "doc", "component_id")
        others = join_by_size(at, some, "name", "inner").withColumn("col", tile(8, "cut")).select("name", each("tiles").alias("row"), "col", "doc", "component_id")
        tiles = spread.union(others).select(F.xxhash64("name", "row", "col").alias("tile"), "doc", "component_id").distinct()
        tiles = tiles.join(sets.select("doc", "n", "sketch"), "doc").groupBy(F.pmod(F.xxhash64("tile"), F.lit(bins)).alias("bin"))
        second = tiles.applyInArrow(open_pairs(num, den, block), "tile long, part long, piece long, doc long")
        second = shared_table(second.select(F.xxhash64("tile", "part", "piece").alias("block"), "doc"))
        if second.limit(1).count():
            links = links.union(compared(docs, second, width, num, den))
    class_of = components(links)
    heads = sets.join(class_of.withColumnRenamed("id", "doc"), "doc", "left").select("n", "sig", "sig2", F.coalesce("component_id", "doc").alias("component_id"))
    return info.join(heads, ["n", "sig", "sig2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
