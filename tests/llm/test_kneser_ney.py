import math
import random
import re
import zlib
from collections import Counter, defaultdict

from tidemark.llm.kneser_ney import discounts, score_texts


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    uni, pair = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = words(t)
            uni.update(w)
            pair.update(zip(["<s>", *w[:-1]], w))
    total, v = sum(uni.values()), len(uni)
    after, before, context = defaultdict(Counter), Counter(), Counter()
    for (a, b), c in pair.items():
        after[a][min(c, 3)] += 1
        before[b] += 1
        context[a] += c
    up = discounts([sum(c == k for c in pair.values()) for k in range(1, 5)])
    low = discounts([sum(c == k for c in before.values()) for k in range(1, 5)])
    rest = sum(low[min(c, 3)] for c in before.values()) / len(pair)

    def p(a, b):
        q = rest / (v + 1) + max(before[b] - low[min(before[b], 3)], 0) / len(pair)
        if not context[a]:
            return q
        c = pair[a, b]
        return max(c - up[min(c, 3)], 0) / context[a] + sum(up[k] * n for k, n in after[a].items()) / context[a] * q

    out = {}
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        out[i] = (held[i], len(w), sum(uni[x] > 0 for x in w), total, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(60)] + ["Été", "THE"]
    rows = [(i, " ".join(r.choices(vocab, weights=[1 / (k + 1) for k in range(62)], k=r.randint(0, 40))) if i % 19 else None) for i in range(200)]
    rows += [(500, "never seen before"), (501, "\t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS i").repartition(3)
    got = {x.doc_id: tuple(x)[1:] for x in score_texts(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4]
        assert abs(got[k][4] - want[k][4]) < 1e-8 and abs(got[k][5] - want[k][5]) < 1e-6


def test_without_training_rows(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    two = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(x.doc_id, x.held_out, x.n_known) for x in score_texts(two).collect()] == [(None, False, 2)] * 2
