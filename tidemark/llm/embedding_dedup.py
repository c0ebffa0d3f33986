"""Near-duplicate vectors: a subspace pigeonhole join.

Vectors of cosine c or more are, at unit length, within squared distance 2 - 2c.  After a rotation
the coordinates are split into ``blocks`` low-dimensional subspaces; in one of them at least the
squared distance is within the proportional budget (2 - 2c) / blocks.  Each subspace is range-joined by
itself: vectors go to the cell of the nearest pivot and visit each later cell that their ball can
reach, and a cell compares its residents with all that it holds, by the boxes of a k-d tree.

The range join is dealt rotated coordinates of one byte each.  With the rounding allowed for, they
rule out pairs that are too far apart in the subspace or as a whole, and pairs that an earlier
subspace has for certain.  The vectors that are left over in a cell are fetched, and their pairs are
verified by the cosine of the original vectors in double precision.  A verified pair counts in the
first subspace that has it within budget (by rounding none may: then in its closest one), so the
union needs no list of pairs.  Only counts and a spanning forest leave a cell.

Equal vectors (by a 128-bit hash) are collapsed first; their numbers follow the order of their
smallest ids.  Pivots come from a bounded sample; they decide only where work is done, never what is
found.  The sample also tells which cells will be crowded; these are cut into tiles.

Null, zero or non-finite vectors link with nothing, and vectors of different lengths are not
compared.  Rows that repeat an id and a vector are one vector with one result each; different
vectors under one id are each a vector.  A null id sorts first and is an id as any other.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, components, pack, release, shared_table, smallest_reachable, stacked

SLACK = 1e-9
#: Coordinates are rounded to multiples of 1 / STEPS; a vector's distance from its rounded self in one dimension.
STEPS = 127
ROUNDING = 0.5 / STEPS
TILE = ["dim", "space", "cell", "low", "high"]


def subspaces(dim: int, blocks: int) -> list:
    """Slices of the rotated coordinates."""
    import numpy as np

    edges = np.linspace(0, dim, min(blocks, max(1, dim // 4)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def rotation(dim: int):
    import numpy as np

    return np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))[0]


def unit(x):
    """Rows at unit length; scaled first, so that squares neither overflow nor vanish."""
    import numpy as np

    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def distances(a, b):
    """Squared distances of all rows of a to all of b."""
    import numpy as np

    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def by_length(batch, at: int):
    """(row numbers, matrix) of the vectors of each length."""
    import numpy as np
    import pyarrow as pa

    vectors = batch.column(at)
    sizes = vectors.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == dim)
        yield mine, vectors.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim)


def visits(z, pivots):
    """(row, cell, is it at home) of the cells that each row's ball of the given radius reaches."""
    import numpy as np

    p, radius = pivots
    apart = np.sqrt(distances(p, p))
    step = max(16, (1 << 22) // len(p))
    for lo in range(0, len(z), step):
        d = distances(z[lo : lo + step], p)
        home = d.argmin(1)
        rows = np.arange(len(d))
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(apart[home] > 1e-6, (d - d[rows, home][:, None]) / (2 * apart[home]), 0)  # equal pivots are all visited
        row, cell = np.nonzero((beyond <= radius + 1e-6) & (np.arange(len(p))[None, :] >= home[:, None]))
        yield row + lo, cell, home[row] == cell


def deal(shared, blocks: int, cosine: float):
    """Arrow mapper: (key, vector) to (tile, packed rounded vectors)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivots, tiles = shared.value
        names = [*TILE, "block"]
        for batch in (b.slice(i, 4000) for b in batches for i in range(0, b.num_rows, 4000)):
            keys = batch.column(0).to_numpy()
            for mine, x in by_length(batch, 1):
                dim = x.shape[1]
                z = unit(x.astype(np.float64)) @ rotation(dim)
                rounded = np.rint(z * STEPS).astype(np.int8)
                parts = subspaces(dim, blocks)
                radius = np.sqrt((2 - 2 * cosine) / len(parts)) + SLACK
                key, out = keys[mine], []
                for b, s in enumerate(parts):
                    p = pivots[dim][:, s] if dim in pivots else np.zeros((1, s.stop - s.start))
                    cut = tiles.get((dim, b), np.ones(len(p), np.int64))
                    for row, cell, resident in visits(z[:, s], (p, radius)):
                        many = cut[cell]
                        part = key[row] * 0x9E3779B1 % (1 << 31) % many
                        for k in range(int(many.max()) if len(many) else 0):  # a vector meets every other part of its cell in one tile
                            go = np.flatnonzero(k < many)
                            out.append((np.full(len(go), b), cell[go], np.minimum(part[go], k), np.maximum(part[go], k), row[go], part[go], resident[go]))
                b, cell, low, high, row, part, resident = (np.concatenate(c) for c in zip(*out))
                order = np.lexsort((row, high, low, cell, b))
                tile = np.stack([b, cell, low, high], 1)[order]
                row, part, resident = row[order], part[order], resident[order]
                new = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1)])
                rows = [pack([key[r], part[i:j].astype(np.int32), resident[i:j].astype(np.uint8), rounded[r].ravel()]) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(row)]) for r in [row[i:j]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), dim, np.int32)), *(pa.array(tile[new, k].astype(np.int32)) for k in range(4)), pa.array(rows, pa.binary())], names)

    return run


def meets(part, resident, cut: bool, h, there):
    """Which pairs of rows h and ``there`` a tile is to compare."""
    import numpy as np

    out = (resident[there] == 0)[None, :] | (there[None, :] > h[:, None])
    return out & (part[h][:, None] != part[there][None, :]) if cut else out


def near_boxes(z, rows, radius: float, size: int = 128):
    """(some of the rows, all that lie within ``radius`` of their box), for the leaves of a k-d tree over ``rows``."""
    import numpy as np

    away = lambda v, a, b: np.maximum(np.maximum(a - v, v - b), 0) ** 2
    limit = radius * radius + 1e-6
    low, high = z[rows].min(0), z[rows].max(0)
    far = away(z, low, high).sum(1)
    others = np.flatnonzero(far <= limit)
    todo = [(rows, others, low, high, far[others])]
    while todo:
        rows, others, low, high, far = todo.pop()
        axis = int((high - low).argmax())
        if len(rows) <= size or high[axis] == low[axis]:
            yield from ((rows[at : at + 2 * size], others) for at in range(0, len(rows), 2 * size))
            continue
        v, w = z[rows, axis], z[others, axis]
        left = v <= np.median(v)
        if left.all():
            left = v < high[axis]
        without = far - away(w, low[axis], high[axis])
        for part in (left, ~left):
            a, b = low.copy(), high.copy()
            a[axis], b[axis] = v[part].min(), v[part].max()
            now = without + away(w, a[axis], b[axis])
            stay = now <= limit
            todo.append((rows[part], others[stay], a, b, now[stay]))


def left_over(blocks: int, cosine: float):
    """Group function over one tile: the rows (tile, key, part, resident) that may have a partner in it."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        dim, b, cell, low, high = (table.column(c)[0].as_py() for c in TILE)
        key, part, resident, q = stacked(table.column("block").to_pylist(), 4, [np.int64, np.int32, np.uint8, np.int8])
        order = np.argsort(key, kind="stable")
        key, part, resident, q = key[order], part[order], resident[order], q.reshape(-1, dim)[order]
        parts = subspaces(dim, blocks)
        near = np.sqrt((2 - 2 * cosine) / len(parts))
        off = [2 * ROUNDING * np.sqrt(s.stop - s.start) + 1e-5 for s in parts]
        whole = (np.sqrt(2 - 2 * cosine) + 2 * ROUNDING * np.sqrt(dim) + 1e-5) ** 2
        z = q.astype(np.float32) / STEPS
        found = np.zeros(len(key), bool)
        home = np.flatnonzero(resident == 1)
        for h, there in near_boxes(z[:, parts[b]], home, near + off[b]) if len(home) else ():
            ok = distances(z[h][:, parts[b]], z[there][:, parts[b]]) <= (near + off[b]) ** 2
            ok &= meets(part, resident, low != high, h, there)
            if ok.mean() > 0.02:  # a crowd: whole matrices are cheaper than lists of pairs
                ok &= distances(z[h], z[there]) <= whole + 1e-4
                for e in range(b):
                    ok &= ~(distances(z[h][:, parts[e]], z[there][:, parts[e]]) <= max(near - off[e], 0) ** 2 - 1e-4)
                found[h[ok.any(1)]] = found[there[ok.any(0)]] = True
                continue
            i, j = np.nonzero(ok)
            i, j = h[i], there[j]
            for lo in range(0, len(i), 100_000):
                a, c = i[lo : lo + 100_000], j[lo : lo + 100_000]
                gap = np.add.reduceat((z[a] - z[c]) ** 2, [s.start for s in parts], axis=1)
                keep = gap.sum(1) <= whole
                for e in range(b):
                    keep &= ~(gap[:, e] <= max(near - off[e], 0) ** 2)
                found[a[keep]] = found[c[keep]] = True
        r = np.flatnonzero(found)
        tile = [pa.array(np.full(len(r), v, np.int32)) for v in (dim, b, cell, low, high)]
        return pa.Table.from_arrays([*tile, pa.array(key[r]), pa.array(part[r]), pa.array(resident[r].astype(np.int32))], [*TILE, "key", "part", "resident"])

    return run


def verify(blocks: int, cosine: float):
    """Group function over what is left of one tile: (kind 0: key, links) and (kind 1: link of a spanning forest)."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        dim, b, low, high = (table.column(c)[0].as_py() for c in ("dim", "space", "low", "high"))
        key, weight, part, resident = (table.column(c).to_numpy() for c in ("key", "weight", "part", "resident"))
        x = np.array(table.column("vector").combine_chunks().flatten().to_numpy(), np.float64).reshape(len(key), dim)
        order = np.argsort(key, kind="stable")
        key, weight, part, resident, x = key[order], weight[order], part[order], resident[order], x[order]
        u = unit(x)
        z = u @ rotation(dim)
        parts = subspaces(dim, blocks)
        budget = (2 - 2 * cosine) / len(parts)
        home = np.flatnonzero(resident == 1)
        every = np.arange(len(key))
        links, up = np.zeros(len(key), np.int64), every
        rows = max(1, min(256, (1 << 20) // len(key)))
        for at in range(0, len(home), rows):
            h = home[at : at + rows]
            cos = u[h] @ u.T
            near = (cos >= cosine - 1e-12) & meets(part, resident, low != high, h, every)
            a, c = np.nonzero(near & (cos < cosine + 1e-12))  # too close to tell: by the plain formula
            if len(a):
                p, r = x[h[a]], x[c]
                near[a, c] = np.einsum("ij,ij->i", p, r) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", r, r))) >= cosine
            within = lambda e: distances(z[h][:, parts[e]], z[:, parts[e]]) <= budget
            for e in range(b):
                near &= ~within(e) if near.any() else False
            if not near.any():
                continue
            mine = within(b)
            none = near & ~mine
            for e in range(b + 1, len(parts)):
                none &= ~within(e) if none.any() else False
            near &= mine
            a, c = np.nonzero(none)  # no subspace has them by rounding: the closest counts
            if len(a):
                near[a, c] = np.add.reduceat((z[h[a]] - z[c]) ** 2, [s.start for s in parts], axis=1).argmin(1) == b
            links[h] += (near * weight[None, :]).sum(1)
            links += (near * weight[h][:, None]).sum(0)
            a, c = np.nonzero(near)
            if len(a):
                up = smallest_reachable(np.r_[h[a], np.arange(len(key))], np.r_[c, up], len(key))
        some, moved = np.flatnonzero(links), np.flatnonzero(up != np.arange(len(key)))
        return pa.table({"kind": pa.array(np.r_[np.zeros(len(some)), np.ones(len(moved))].astype(np.int32)), "a": pa.array(np.r_[key[some], key[moved]]), "b": pa.array(np.r_[links[some], key[up[moved]]])})

    return run


def pivots_of(vectors: DataFrame, n: int, blocks: int, per_cell: int, per_tile: int, sample: int):
    """({dimension: pivots}, {(dimension, block): tiles of each cell}) from a bounded sample."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()
    pivots, tiles = {}, {}
    for dim in sorted({len(r.vector) for r in rows}):
        z = unit(np.array([r.vector for r in rows if len(r.vector) == dim], np.float64)) @ rotation(dim)
        want = min(len(z), max(1, n // per_cell))
        pivots[dim] = z[:want]
        for b, s in enumerate(subspaces(dim, blocks)):
            home = np.concatenate([distances(z[i : i + 512, s], z[:want][:, s]).argmin(1) for i in range(0, len(z), 512)])
            there = np.bincount(home, minlength=want) * (n / len(rows))
            tiles[dim, b] = np.maximum(np.ceil(there / per_tile), 1).astype(np.int64)
    return pivots, tiles


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, blocks: int = 8, per_cell: int = 20_000, per_tile: int = 20_000, sample: int = 4096) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest id reachable), kept.

    ``per_cell`` vectors a pivot are aimed at (a pivot is one of the ``sample``), tiles of at most about ``per_tile`` residents.
    """
    spark = vectors.sparkSession
    usable = F.expr("vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vector, x -> x <> 0)")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    hashed = rows.select("id", *(F.when(F.col("ok"), F.xxhash64("vector", F.lit(k))).alias(f"h{k}") for k in (1, 2)), "vector")
    distinct = shared_table(hashed.where("h1 IS NOT NULL").groupBy("id", "h1", "h2").agg(F.first("vector").alias("vector")))
    classes = distinct.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = shared_table(classes.orderBy("id", "h1", "h2").withColumn("key", F.monotonically_increasing_id()))
    one = shared_table(distinct.join(classes, ["id", "h1", "h2"]).select("key", "weight", "vector"))
    release(distinct)
    n = one.count()
    shared = spark.sparkContext.broadcast(pivots_of(one, n, blocks, per_cell, per_tile, sample))
    ints = lambda names: ", ".join(f"{c} int" for c in names)
    dealt = one.select("key", "vector").mapInArrow(deal(shared, blocks, cosine), ints(TILE) + ", block binary")
    left = shared_table(dealt.groupBy(*TILE).applyInArrow(left_over(blocks, cosine), ints(TILE) + ", key long, part int, resident int"))
    found = shared_table(left.join(one, "key").groupBy(*TILE).applyInArrow(verify(blocks, cosine), "kind int, a long, b long"))
    release(left, one)
    links = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("links"))
    class_of = components(found.where("kind = 1").select("a", "b"))
    names = classes.select(F.col("key").alias("component"), F.col("id").alias("component_id"))
    known = classes.join(links, "key", "left").join(class_of.select(F.col("id").alias("key"), F.col("component_id").alias("component")), "key", "left")
    known = known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "key").alias("component"))
    known = known.join(names, "component").select("h1", "h2", "n_links", "component_id")
    out = hashed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("id").alias("vec_id"), "n_links", null("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
