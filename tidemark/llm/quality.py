"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are its words, hashed to ``2**BITS`` slots with log-scaled counts of unit length,
statistics of its structure, and numeric metadata columns.  The pairwise interactions of all features have rank
``RANK`` and are summed in linear time: half of (sum of v x) squared less the sum of (v x) squared.

The machine is fitted on the driver from at most ``sample`` labelled rows, the first by a hash of
their id, so the fit has a fixed size at any scale; every document is scored by a narrow map, and
the broadcast model has a fixed size too.  Neither labels nor ids are features.

A null text counts as empty and is scored by its structure; null metadata count as 0.  A null id
is kept and never held out.  Rows of labels that repeat an id count once, with the smallest label; of
documents that repeat a labelled id one is learnt from, and each is scored.  Texts of any length are
judged whole, a chunk of texts or one text at a time.
Without any label the score is 0.5.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .textops import Words, row_chunks, text_chunks

BITS, RANK = 14, 8
#: Byte classes: upper case, lower case, digits, blanks, line ends, marks of prose, other marks, beyond ASCII.
CLASSES = 8


def byte_classes():
    import numpy as np

    c = np.full(256, 6, np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, 7
    c[[32, 9]], c[[10, 11, 12, 13]] = 3, 4
    c[[ord(x) for x in ".,;:'\"?-()"]] = 5
    return c


class Features:
    """Hashed words and structure statistics of chunks of texts."""

    def __init__(self):
        self.words = Words("space")
        self.classes = byte_classes()

    def of(self, ids, offsets, data):
        """(text, slot, value) of the words and a dense table of statistics."""
        import numpy as np

        n = len(ids)
        starts, ends, low = self.words.find(offsets, data)
        h = self.words.hashes(starts, ends, low)
        first = self.words.per_text(offsets, starts)
        count = np.diff(first)
        text = np.repeat(np.arange(n), count)
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        key, times = np.unique((text << BITS) | slot, return_counts=True)
        t, slot = key >> BITS, key & ((1 << BITS) - 1)
        value = np.log1p(times)
        value /= np.sqrt(np.bincount(t, value * value, n))[t]
        size = np.diff(offsets)
        by_class = np.bincount(np.repeat(np.arange(n), size) * CLASSES + self.classes[data], minlength=n * CLASSES).reshape(n, CLASSES)
        share = by_class / np.maximum(size, 1)[:, None]
        again = np.zeros(n)
        if len(h) > 1:
            same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
            again = np.bincount(text[1:][same], minlength=n) / np.maximum(count, 1)
        most = np.zeros(n)
        np.maximum.at(most, t, times)
        last = self.classes[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
        marked = np.bincount(text[last == 6], minlength=n) / np.maximum(count, 1)
        stopped = np.bincount(text[last == 5], minlength=n) / np.maximum(count, 1)
        distinct = np.bincount(t, minlength=n) / np.maximum(count, 1)
        length = np.bincount(text, ends - starts, n) / np.maximum(count, 1)
        dense = np.column_stack([share, again, most / np.maximum(count, 1), marked, stopped, distinct, np.log1p(length), np.log1p(count), np.log1p(size)])
        return t, slot, value, dense


def feature_rows():
    """Arrow mapper: (id, text, metadata, label) to packed features of the labelled sample."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import pack

        make = Features()
        for batch in batches:
            meta = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            label = batch.column(3).to_numpy(zero_copy_only=False)
            at = 0
            for ids, offsets, data in text_chunks([batch]):
                t, slot, value, dense = make.of(ids, offsets, data)
                rows = slice(at, at + len(ids))
                at += len(ids)
                block = pack([np.bincount(t, minlength=len(ids)).astype(np.int64), slot.astype(np.int32), value.astype(np.float32), np.column_stack([dense, meta[rows]]).ravel(), label[rows].astype(np.int64), ids])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    return run


class Machine:
    """The fitted machine; ``scores`` evaluates it."""

    def __init__(self, bias, weight, factors, centre, scale):
        self.bias, self.weight, self.factors, self.centre, self.scale = bias, weight, factors, centre, scale

    def scores(self, t, slot, value, dense):
        import numpy as np

        n = len(dense)
        x = np.clip((dense - self.centre) / self.scale, -4, 4)
        words = 1 << BITS
        linear = self.bias + np.bincount(t, self.weight[slot] * value, n) + x @ self.weight[words:]
        total = x @ self.factors[words:]
        squares = (x * x) @ (self.factors[words:] ** 2)
        for f in range(self.factors.shape[1]):
            vx = self.factors[slot, f] * value
            total[:, f] += np.bincount(t, vx, n)
            squares[:, f] += np.bincount(t, vx * vx, n)
        z = linear + 0.5 * (total * total - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(blocks: list, metas: int, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss, Adam, rows in a fixed order that depends on ids only."""
    import numpy as np

    from .common import unpack

    words = 1 << BITS
    parts = [unpack(b) for b in blocks]
    width = CLASSES + 8 + metas
    rng = np.random.Generator(np.random.PCG64(seed))
    if not parts:
        return Machine(0.0, np.zeros(words + width), np.zeros((words + width, RANK)), np.zeros(width), np.ones(width))
    sizes, slot, value, dense, label, ids = (np.concatenate([p[i] for p in parts]) for i in range(6))
    dense = dense.reshape(len(label), -1)
    start = np.cumsum(sizes) - sizes
    centre, scale = dense.mean(0), dense.std(0) + 1e-3
    x_all = np.clip((dense - centre) / scale, -4, 4)
    weight, factors, bias = np.zeros(words + width), rng.normal(0, 0.02, (words + width, RANK)), 0.0
    m = [np.zeros_like(weight), np.zeros_like(factors), 0.0]
    v = [np.zeros_like(weight), np.zeros_like(factors), 0.0]
    steady = np.argsort(ids, kind="stable")
    step = 0
    for _ in range(epochs):
        order = steady[rng.permutation(len(label))]
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = len(rows)
            k = sizes[rows]
            at = np.repeat(start[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            t, s, val = np.repeat(np.arange(n), k), slot[at].astype(np.int64), value[at].astype(np.float64)
            x = x_all[rows]
            vs = factors[s] * val[:, None]
            total = np.zeros((n, RANK))
            np.add.at(total, t, vs)
            total += x @ factors[words:]
            squares = np.bincount(t, (vs * vs).sum(1), n) + (x * x) @ (factors[words:] ** 2).sum(1)
            z = bias + np.bincount(t, weight[s] * val, n) + x @ weight[words:] + 0.5 * ((total * total).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / n
            gw = decay * weight
            gw[:words] += np.bincount(s, g[t] * val, words)
            gw[words:] += x.T @ g
            gv = decay * factors
            each = (g[t] * val)[:, None] * (total[t] - vs)
            for f in range(RANK):
                gv[:words, f] += np.bincount(s, each[:, f], words)
            gv[words:] += x.T @ (g[:, None] * total) - factors[words:] * ((x * x).T @ g)[:, None]
            step += 1
            for i, (p, grad) in enumerate(((weight, gw), (factors, gv))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            m[2] = 0.9 * m[2] + 0.1 * g.sum()
            v[2] = 0.999 * v[2] + 0.001 * g.sum() ** 2
            bias -= rate * (m[2] / (1 - 0.9**step)) / (np.sqrt(v[2] / (1 - 0.999**step)) + 1e-8)
    return Machine(bias, weight, factors, centre, scale)


def scorer(shared):
    """Arrow mapper: (id, text, metadata, held out) to (id, held out, score, predicted)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make, machine = Features(), Machine(*shared.value)
        for batch in row_chunks(batches, 1):
            meta = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            at, out = 0, []
            keys = batch.column(0)
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["i", "text"])
            for ids, offsets, data in text_chunks([rows]):
                t, slot, value, dense = make.of(ids, offsets, data)
                out.append(machine.scores(t, slot, value, np.column_stack([dense, meta[at : at + len(ids)]])))
                at += len(ids)
            score = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([keys, batch.column(3), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def keeper(shared, text_at: int, meta_at: int):
    """Arrow mapper: whole rows of documents; those that are predicted 1 stay."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make, machine = Features(), Machine(*shared.value)
        for batch in row_chunks(batches, text_at):
            meta = np.array(batch.column(meta_at).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], ["i", "text"])
            good, at = np.zeros(batch.num_rows, bool), 0
            for ids, offsets, data in text_chunks([rows]):
                t, slot, value, dense = make.of(ids, offsets, data)
                good[ids] = machine.scores(t, slot, value, np.column_stack([dense, meta[at : at + len(ids)]])) >= 0.5
                at += len(ids)
            yield batch.select([i for i in range(batch.num_columns) if i != meta_at]).filter(pa.array(good))

    return run


def fold_of(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def metadata(documents: DataFrame, meta_cols: tuple):
    """An array column: 0 and the log-scaled metadata columns that the table has."""
    return F.array(F.lit(0.0), *(F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in meta_cols if c in documents.columns))


def trained(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: tuple, sample: int, folds: int, held: int):
    """The machine fitted on the labelled sample, as a broadcast of fixed size."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), metadata(documents, meta_cols).alias("meta"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold_of("doc_id", folds) != held)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(known), "doc_id")  # at most ``sample`` ids; of one that is repeated, the text with the least hash
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "meta")).alias("x")).select("doc_id", "x.text", "x.meta", "label")
    metas = 1 + sum(c in documents.columns for c in meta_cols)
    m = fit([r.block for r in rows.mapInArrow(feature_rows(), "block binary").collect()], metas)
    return documents.sparkSession.sparkContext.broadcast((m.bias, m.weight, m.factors, m.centre, m.scale))


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple = ("n_chars",), sample: int = 8000, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``documents``, all columns, that the classifier does not reject; a narrow map."""
    shared = trained(documents, labels, id_col, text_col, label_col, meta_cols, sample, folds, held)
    rows = documents.withColumn(fresh("meta", documents), metadata(documents, meta_cols))
    return rows.mapInArrow(keeper(shared, rows.columns.index(text_col), len(rows.columns) - 1), documents.schema)


def score_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple = ("n_chars",), sample: int = 8000, folds: int = 3, held: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score (higher: label 1 likelier), predicted."""
    shared = trained(documents, labels, id_col, text_col, label_col, meta_cols, sample, folds, held)
    out = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), metadata(documents, meta_cols).alias("meta"))
    out = out.withColumn("held_out", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)))
    return out.mapInArrow(scorer(shared), "doc_id long, held_out boolean, score double, predicted int")
