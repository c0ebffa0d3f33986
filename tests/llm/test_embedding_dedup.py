import numpy as np

from tidemark.llm.embedding_dedup import near_vectors


def brute(rows, cosine):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float64)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(up, 0)
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (n[i], root(i), root(i) == i) for i in up}


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 24))
    rows = []
    for i in range(700):
        v = base[r.integers(60)] * r.uniform(0.1, 9) + r.normal(size=24) * r.choice([0, 0.05, 0.2, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [1.0] * 23 + [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS links", "2 AS id").repartition(3)
    want = brute(rows, 0.95)
    for more in ({}, {"per_cell": 20, "sample": 200}, {"per_cell": 5, "sample": 300, "blocks": 3}, {"per_cell": 50, "per_tile": 9}):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df, **more).collect()}
        assert got == want


def test_empty_and_nulls(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect())
    assert got == [(-1, 1, None, True), (3, 1, None, False), (3, 1, None, False), (4, 0, 4, True)]


def test_ids_with_several_vectors(spark):
    """Different vectors under one id, or under no id, are each a vector."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (3, [0.01, 1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0, 0.01])]
    got = sorted((x.vec_id or -1, x.n_links, x.component_id or -1, x.kept) for x in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(-1, 0, -1, True), (-1, 1, -1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 1, -1, False)]


def test_crowd_and_copies(spark):
    """A third of the rows in one tight crowd of different vectors, a third exact copies; huge and tiny values."""
    r = np.random.default_rng(2)
    centre, other = r.normal(size=16), r.normal(size=16)
    rows = [(i, [float(x) for x in centre + r.normal(size=16) * 0.01]) for i in range(300)]
    rows += [(i, [float(x) for x in other]) for i in range(300, 600)]
    rows += [(i, [float(x) for x in r.normal(size=16)]) for i in range(600, 880)] + [(900, [1e-200] * 16), (901, [1e200] * 16), (902, [2e200] * 16)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=40, per_tile=50).collect()}
    assert all(got[i] == (299, 0) for i in range(300)) and all(got[i] == (299, 300) for i in range(300, 600))
    assert [got[i] for i in (900, 901, 902)] == [(2, 900)] * 3
