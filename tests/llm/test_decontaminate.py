import hashlib
import random
import re

from tidemark.llm.decontaminate import find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := wins.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def data(seed):
    r = random.Random(seed)
    vocab = ["alpha", "béta", "Gamma", "d4", "e-f", "x_y", "of", "the", "o'k"] + ["w%d" % i for i in range(30)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 9, 10, 11, 25])))) for i in range(25)] + [(None, "the of"), (77, None)]
    docs = []
    for d in range(150):
        t = r.choices(vocab, k=r.randint(0, 900 if d % 50 == 0 else 60))
        if d % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = (r.choice(items)[1] or "").upper().split()[: r.randint(5, 30)]
        docs.append((d, ", ".join(t) if d % 40 else None))
    return docs, items


def test_against_brute_force(spark):
    docs, items = data(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS spans").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(find_leaks(d, b)) == brute(docs, items)
    assert got(find_leaks(d, b, block_bytes=300)) == brute(docs, items)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(none, items).collect() == []
    one = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in find_leaks(one, items).collect()) == [(0, 0, 0), (1, 2, 0)]
