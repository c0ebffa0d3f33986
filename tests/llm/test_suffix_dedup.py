import hashlib
import random

from tidemark.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            g = raw[s : s + length]
            if g in seen:
                gone[s : s + length] = [True] * length
            seen.add(g)
        kept = bytes(b for b, x in zip(raw, gone) if not x)
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß ", k=r.randint(2, 9))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=40))
    out = []
    for i in range(120):
        t = " ".join(r.choices(words, k=r.randint(0, 120)))
        if i % 3 == 0:
            t += passage[r.randint(0, 60) :] + " ".join(r.choices(words, k=9))
        if i % 5 == 0 and out:
            b = list(out[r.randrange(len(out))][1] or "")
            for _ in range(r.randint(0, 3)):
                if b:
                    b[r.randrange(len(b))] = "z"
            t = "".join(b)
        if i % 17 == 0:
            t = "ab" * r.randint(1, 200)
        out.append((i, t if i % 29 else None))
    r.shuffle(out)
    return out


def check(spark, data, length, **more):
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "'x' AS doc").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, length=length, **more).collect()}
    assert got == brute(data, length)


def test_against_brute_force(spark):
    check(spark, rows(1), 100)


def test_short_strings_and_hot_anchors(spark):
    check(spark, rows(2), 48, hot=2)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []
    text = "the quick brown fox " * 3 + "x" * 60
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(False, 0, 0), (True, 3, 120), (True, 3, 120), (True, 4, 0)]


def test_ids_with_several_texts(spark):
    """Texts of one id, or of no id, are documents of their own in order of their digests."""
    a, b, c = ("a" + "qwertyuiop" * 15, "b" + "qwertyuiop" * 15, "short")
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c), (None, a), (None, ""), (None, None), (5, c)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    # within a text of period ten all but its first strings repeat; across texts of no id and of id 1 all but the first letter
    assert [x for x in got if x[1] != len(a)] == [(0, 0, 0), (0, 0, 0), (0, 5, 0), (5, 5, 0)]
    whole = [x for x in got if x[1] == len(a)]
    assert whole[0][0] == 0 and whole[0][2] < len(a) - 1 and [x[2] for x in whole[1:]] == [len(a) - 1, len(a) - 1, len(a)]


def test_long_text_in_segments(spark, monkeypatch):
    """A text longer than a segment, cut at places that lie inside repeats, against the plain definition."""
    monkeypatch.setattr("tidemark.llm.suffix_dedup.SEGMENT", 700)
    import random

    r = random.Random(3)
    part = ["".join(r.choices("abcdefgh ", k=r.randint(90, 400))) for _ in range(12)]
    rows = [(i, "".join(r.choices(part, k=r.randint(1, 25)))) for i in range(8)]
    seen, want = set(), {}
    for d, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(t[s : s + 100])
        want[d] = sum(gone)
    for hot in (50_000, 1):
        got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        assert got == want
