import hashlib
import math

import numpy as np
import pytest

from tidemark.operators.simulate import panel, simulate_ar1
from tidemark.plans import queries


def draw(tag, *parts):
    return int(hashlib.md5("|".join([tag, "0", *map(str, parts)]).encode()).hexdigest()[:8], 16)


def brute(key, x, n_boot):
    a, b = x[:-1], x[1:]
    m, length = len(a), max(2.0, len(x) ** (1 / 3))
    lives = []
    for rep in range(1, n_boot + 1):
        idx, blk = [], 0
        for i in range(m):
            if i == 0 or draw("n", key, rep, i - 1) / 4294967296.0 < 1 / length:
                blk += 1
                at = draw("s", key, rep, blk) % m
            idx.append(at % m)
            at += 1
        u, v = a[idx], b[idx]
        slope = ((u - u.mean()) * (v - v.mean())).sum() / ((u - u.mean()) ** 2).sum()
        if 0 < slope < 1:
            lives.append(math.log(2) / -math.log(slope))
    return (len(lives), *(np.quantile(lives, [0.025, 0.975]) if len(lives) >= n_boot / 2 else (None, None)))


def test_registered_interval_has_2000_replicates(spark, monkeypatch):
    worlds = {"A": simulate_ar1(0.7, 60, seed=3), "B": simulate_ar1(0.1, 45, seed=4), "C": simulate_ar1(-0.8, 40, seed=5), "tiny": np.arange(5.0)}
    monkeypatch.setattr(queries, "series", lambda s, d: panel(s, worlds))
    got = {r.ticker: (r.n_valid, r.lower, r.upper) for r in queries.QUERIES["bootstrap_interval_full"](spark, "").collect()}
    want = {k: brute(k, worlds[k], 2000) for k in "ABC"}
    assert set(got) == set(want) and want["A"][0] > 1000
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-6)
