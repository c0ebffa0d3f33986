import math
import random
from pathlib import Path

import pytest

from tidemark.llm import sentencepiece_codec as S
from tidemark.llm.sentencepiece_codec import MODEL, Codec, double_array, encode_digest, load_pieces, log_scores, may_cut

pytestmark = pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def codec():
    pieces, raw = load_pieces()
    return Codec(pieces, raw, double_array(pieces))


@pytest.fixture(scope="module")
def known():
    """Pieces and log scores from the file itself, by a formula of the test's own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    total = sum(1 / (1 + r) for r in ranks.values())
    return {p: math.log(1 / (1 + r) / total) for p, r in ranks.items()}


def pieces_of(codec, ids):
    """Pieces of a path; runs of byte ids that make a character are one entry."""
    out, run = [], b""
    for i in ids:
        if i in codec.raw:
            run += bytes([codec.raw.index(i)])
            try:
                out.append((run.decode(), True))
            except UnicodeDecodeError:
                continue
            run = b""
        else:
            out.append((codec.spell[i].decode().replace(" ", "▁"), False))
    return out


def brute(known, text):
    """Best score by plain dynamic programming over the whole text, no trie, no cuts; a text's own markers are spelt out."""
    own = [c == "▁" for c in " " + text]
    text = (" " + text).replace(" ", "▁")
    lost, longest = min(known.values()) - 10, max(map(len, known))
    best = [0.0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        options = [best[i] + known[text[i:e]] for i in range(max(0, e - longest), e) if text[i:e] in known and not any(own[i:e])]
        if text[e - 1] not in known or own[e - 1]:
            options.append(best[e - 1] + lost)
        best[e] = max(options)
    return best[-1]


def ids_of(codec, text):
    return memoryview(codec.encode(text)).cast("I").tolist()


def test_log_scores(known):
    assert abs(sum(map(math.exp, known.values())) - 1) < 1e-9
    assert log_scores([-1.5, -2.0]) == [-1.5, -2.0]
    pieces, _ = load_pieces()
    assert all(abs(p[1] - known[p[0].decode()]) < 1e-9 for p in pieces if p)


def test_premises():
    pieces, _ = load_pieces()
    assert may_cut(pieces) and not may_cut([("a▁b".encode(), -1.0)]) and not may_cut([(b"a\n", -1.0)])


def test_common_words_are_one_piece(codec):
    for text in ("the quick brown", "international government information"):
        assert [p for p, _ in pieces_of(codec, ids_of(codec, text))] == ["▁" + w for w in text.split()]


def test_best_score_and_round_trip(codec, known):
    r = random.Random(4)
    lost = min(known.values()) - 10
    alphabet = "abcdefg tion ing the   éßñ\n\t.,!€漢😀▁"
    for _ in range(80):
        t = "".join(r.choices(alphabet, k=r.randint(1, 60)))
        ids = ids_of(codec, t)
        assert codec.decode(ids) == t.encode()
        got = sum(lost if spelt else known[p] for p, spelt in pieces_of(codec, ids))
        assert abs(got - brute(known, t)) < 1e-6
    for t in ("", "▁", "a▁ b", " ", "  x  ", "\n\n", "a" * 5000):
        assert codec.decode(ids_of(codec, t)) == t.encode()


def test_short_and_long_parts_agree(codec):
    """The two ways of segmenting give the same ids, ties included."""
    r = random.Random(5)
    texts = sorted({"".join(r.choices("abcdeinotrsthé漢😀\t", k=r.randint(1, 20))).encode() for _ in range(500)}, key=lambda t: -len(t))
    assert codec.segment_all(texts) == [codec.segment(t) for t in texts]


def test_very_long_texts(codec, known, monkeypatch):
    r = random.Random(6)
    part = "".join(r.choices("abcdeinotrsth", k=120_000))  # one part; paths are written out on the way
    ids = ids_of(codec, part)
    assert codec.decode(ids) == part.encode()
    assert abs(sum(known[p] for p, _ in pieces_of(codec, ids)) - brute(known, part)) < 1e-3
    text = "one two  three\n" * 3000
    whole = codec.encode(text)
    monkeypatch.setattr(S, "CHUNK", 1000)
    assert codec.encode(text) == whole


def test_few_remembered_parts(codec, monkeypatch):
    texts = ["alpha beta gamma", "delta beta", "alpha delta epsilon"]
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(S, "REMEMBER", 3)
    assert [codec.encode(t) for t in texts] == want and codec.encode_all(texts) == want


def test_query_rows(spark):
    df = spark.createDataFrame([(1, "the word"), (None, None), (2, ""), (2, ""), (3, None)], "doc_id long, text string").selectExpr("text", "doc_id", "1 AS n_tokens")
    rows = sorted(((r.doc_id or 0, r.n_tokens, r.round_trip, len(r.token_ids)) for r in encode_digest(df, tokens=True).collect()), key=str)
    assert rows == [(0, 0, True, 0), (1, 2, True, 2), (2, 0, True, 0), (2, 0, True, 0), (3, 0, True, 0)]
    assert encode_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
