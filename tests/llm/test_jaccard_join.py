import random
import re

from tidemark.llm.jaccard_join import joined_lists, linked


def brute(rows, width=4, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def make(seed, n=260):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "Zz", " x"]
    passage = r.choices(words, k=60)
    out, base = [], r.choices(words, k=150)
    for i in range(n):
        if i % 4 == 0:  # near copies of one text, and of copies
            t = list(base if i % 8 else (out[-4][1] or "x").split(" ") if len(out) > 4 else base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = r.choice(words)
        elif i % 4 == 1:
            t = passage + r.choices(words, k=r.randint(0, 40))
        else:
            t = r.choices(words, k=r.choice([0, 1, 2, 3, 4, 5, 30, 90]))
        out.append((i, (" " if i % 3 else " \n").join(t) if i % 31 else None))
    r.shuffle(out)
    return out


def test_group_filter_keeps_every_pair_that_may_be_similar():
    """Against the filter on all pairs of a list."""
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(60):
        k = int(r.integers(1, 40))
        item, n = np.sort(r.integers(0, 3, k)), r.integers(1, 25, k)
        order = np.lexsort((n, item))
        item, n = item[order], n[order]
        left = np.array([r.integers(1, x + 1) for x in n])
        up = list(range(k))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(k):
            for j in range(i):
                a, b = sorted((int(n[i]), int(n[j])))
                if item[i] == item[j] and a * 100 >= b * 85 and min(left[i], left[j]) >= -(-85 * (a + b) // 185):
                    up[max(root(i), root(j))] = min(root(i), root(j))
        label = joined_lists(item, n, left, 85, 100)
        assert label.tolist() == [root(i) for i in range(k)]


def test_crowd_without_main_component(spark, monkeypatch):
    """A thousand documents that share a passage and little else, some of them in small groups of near copies."""
    for name, v in (("FILTERED", 50), ("TILE", 64)):
        monkeypatch.setattr(f"tidemark.llm.jaccard_join.{name}", v)
    r = random.Random(8)
    rows = []
    for i in range(1000):
        own = [f"u{i}x{k}" for k in range(12)]
        if i % 10 == 9:  # a near copy of an earlier one
            own = rows[r.randrange(len(rows))][1].split()[8:]
            own.append("z")
        rows.append((i, " ".join(["all of us share these eight words", "here"] + own)))
    check(spark, rows, block=16)


def test_rows_that_share_an_id(spark):
    """Each is a document of its own; components still have the smallest id."""
    a, b, c = ("one two three four five six", "red green blue cyan pink gray", "alpha beta gamma delta epsilon zeta")
    df = spark.createDataFrame([(5, a), (5, b), (9, b), (5, c), (2, c), (7, a), (7, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in linked(df).collect())
    assert got == [(2, 3, 2), (5, 3, 2), (5, 3, 5), (5, 3, 5), (7, 3, 5), (7, 3, 5), (9, 3, 5)]


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[:-1000]])), (3, " ".join(words[:200_000])), (4, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (299_997, 1), 2: (298_998, 1), 3: (199_997, 3), 4: (0, 4)}


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS doc").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked(df, **more).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, make(5))


def test_cut_blocks(spark):
    check(spark, make(6), block=6)


def test_empty_and_repeated(spark):
    assert linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (4, "A b c d e"), (4, "A b c d e"), (7, ""), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in linked(df).collect())
    assert got == [(-1, 2, None), (4, 2, None), (4, 2, None), (7, 0, 7), (8, 0, 8)]


def test_crowded_names_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.jaccard_join.FILTERED", 3)
    check(spark, make(7), block=6)
