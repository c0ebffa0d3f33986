"""Shared folder, packed column blocks, checked broadcasts and connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most this many rows and bytes may be broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24 << 20
#: Parts of a hub's rows in a join that is too large to broadcast.
SALTS = 32
#: Stands for a null id inside an operator, so that null ids survive equi-joins.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a session on a single machine gets a temporary folder; on a cluster,
    whose machines would not share one, that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes shared tables that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name like ``base`` that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; 0 if it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else 0


def bucket_count(df: DataFrame, per_bucket: int, text_col: str = "text") -> int:
    """Buckets of about ``per_bucket`` input bytes, at least one for each shuffle partition.

    Where the optimizer has no size estimate the bytes of text are counted.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if not size and text_col in df.columns:
        size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, math.ceil(size / per_bucket))


def join_by_size(left: DataFrame, right: DataFrame, on: str, how: str, width: int = 64) -> DataFrame:
    """Joins; ``right`` (about ``width`` bytes a row, lineage already cut) is broadcast only if it is small."""
    n = right.count()
    small = n <= BROADCAST_ROWS and n * width <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def pack(arrays: list, level: int = 1) -> bytes:
    """Numpy columns as one compressed block; bytes of equal weight lie together."""
    import struct

    import numpy as np
    import zstandard

    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(4)
        head.append(struct.pack("<4sq", code, len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=level).compress(struct.pack("<i", len(arrays)) + b"".join(head) + b"".join(body))


def unpack(blob: bytes) -> list:
    """The columns that ``pack`` was given."""
    import struct

    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = struct.unpack_from("<i", raw)[0], 4, []
    heads = [struct.unpack_from("<4sq", raw, at + 12 * i) for i in range(n)]
    at += 12 * n
    for code, rows in heads:
        kind = np.dtype(code.decode().strip())
        size = rows * kind.itemsize
        part = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, rows)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(rows))
        at += size
    return out


def stacked(blobs, columns: int, dtypes: list) -> list:
    """Concatenates packed blocks column by column."""
    import numpy as np

    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtypes[i]) for i in range(columns)]


def split_rows(bucket, arrays: list):
    """(bucket, packed block) for each bucket that occurs, rows kept in order."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
        take = order[lo:hi]
        yield int(b[lo]), pack([a[take] for a in arrays])


def smallest_reachable(i, j, n: int):
    """Smallest reachable index of each of n vertices."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches):
    """Links of one task to a spanning forest of (vertex, smallest vertex of its tree)."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        path = []
        while (p := up.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            up[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(up)]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of ``edges`` (two long columns a and b).

    Links become pointers to smaller vertices, (a, b) with b < a.  A round (1) deals the pointers by
    their larger end and replaces those of a task by the stars of its connected parts, so a vertex with
    several pointers has one left there, and (2) moves each pointer to a vertex that points on itself one
    step further.  It ends when every vertex has one pointer, to a vertex without any.

    Before (1) a vertex has at most one pointer from each task, and (2) never deals by the smaller end:
    the different ends are looked up, and the steps joined with salted keys or broadcast.  So no
    task takes a hub's pointers.  Each round is written to the shared folder.  ``component_id`` is the
    smallest vertex reachable.  An empty input gives an empty result.  Null ends are not links and must
    be filtered by the caller.
    """
    schema = "a long, b long"
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, schema)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    old: list = []
    while True:
        e = shared_table(e.repartition(parts, "a").mapInArrow(_forest, schema))
        release(*old)
        old = [e]
        least = e.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n"))
        ends = e.select(F.col("b").alias("a")).distinct()
        steps = shared_table(ends.join(least, "a").select(F.col("a").alias("b"), F.col("b").alias("c")))
        old.append(steps)
        far = steps.count()
        if not far and not least.where("n > 1").limit(1).count():
            release(steps)
            break
        if far <= BROADCAST_ROWS:
            moved = e.join(F.broadcast(steps), "b", "left")
        else:
            salted = steps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            moved = e.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(salted, ["b", "salt"], "left")
        e = moved.select("a", F.coalesce("c", "b").alias("b")).mapInArrow(_forest, schema)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(e.select("b", "b").distinct())
