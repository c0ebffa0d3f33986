import zlib
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm.quality import BITS, CLASSES, RANK, Machine, keep_good, score_quality

DATA = Path("/root/testdata/sf0.1")


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    width = (1 << BITS) + CLASSES + 9
    m = Machine(0.3, r.normal(size=width) / 9, r.normal(size=(width, RANK)) / 9, np.zeros(width - (1 << BITS)), np.ones(width - (1 << BITS)))
    slot, value, dense = np.array([3, 9, 12000]), np.array([0.5, 0.1, 0.7]), r.normal(size=(1, width - (1 << BITS)))
    x = np.zeros(width)
    x[slot] = value
    x[1 << BITS :] = np.clip(dense[0], -4, 4)
    on = np.flatnonzero(x)
    z = m.bias + m.weight @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[:a])
    assert abs(m.scores(np.zeros(3, int), slot, value, dense)[0] - 1 / (1 + np.exp(-z))) < 1e-9


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels)
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.97, auc
    assert np.mean([(r.predicted == r.quality) for r in rows]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "'q' AS label", "1 AS meta")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.held_out) for r in score_quality(docs, labels).collect())
    assert got == [(0, False)] + [(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in (2, 2, 3)]
    none = score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert score_quality(docs.limit(0), labels).collect() == []


def test_repeated_ids_and_clashing_columns(spark):
    """The fit depends neither on the order of rows nor on how often an id is repeated; helper columns give way to the table's own."""
    good, bad = "one plain sentence about rivers and towns. " * 3, "!!! $$$ 123 zzz @@@ " * 4
    rows = [(i, (good if i % 2 else bad) + str(i), i) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    more = docs.union(docs.where("doc_id < 30")).repartition(5)
    want = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    got = {r.doc_id: r.score for r in score_quality(more, labels).collect()}
    assert max(abs(want[k] - got[k]) for k in want) < 1e-9
    wide = docs.selectExpr("*", "7 AS meta", "8 AS meta_")
    kept = keep_good(wide, labels)
    assert kept.columns == wide.columns and {(r.meta, r.meta_) for r in kept.collect()} == {(7, 8)}


def test_very_long_text(spark):
    long = "word another " * 300_000
    docs = spark.createDataFrame([(1, long), (2, "short one"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in score_quality(docs, labels).collect())
