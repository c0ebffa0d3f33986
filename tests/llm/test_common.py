import random

import pytest

from tidemark.llm import common
from tidemark.llm.common import components, shared_dir


def brute(edges):
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def graphs():
    r = random.Random(3)
    path = list(range(1, 60))
    yield [(a, b) for a, b in zip(path, path[1:])]
    r.shuffle(path)
    yield [(a, b) for a, b in zip(path, path[1:])]
    yield [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    yield [(1000, i) for i in range(200)]
    yield [(r.randint(-50, 400), r.randint(-50, 400)) for _ in range(250)]
    yield [(-(1 << 63), (1 << 63) - 1), (5, (1 << 63) - 1), (5, 5)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_components(spark, monkeypatch, rows):
    """Also with every join salted instead of broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    offset, edges = 0, []
    for g in graphs():
        if all(abs(x) < 10_000 for e in g for x in e):
            edges += [(a + offset, b + offset) for a, b in g]
            offset += 10_000
        elif rows:
            got = {r.id: r.component_id for r in components(spark.createDataFrame(g, "a long, b long")).collect()}
            assert got == brute(g)
    random.Random(1).shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.id: r.component_id for r in rows} == brute(edges) and len(rows) == len(brute(edges))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)
