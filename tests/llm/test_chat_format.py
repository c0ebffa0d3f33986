import hashlib
import random

from tidemark.llm.chat_format import MARKED_TURNS, escape, format_chats, read_back, spans, unescape


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choices(["<", "|", "\\", "n", "im_end", ">", "<|im_end|>", "\n"], k=8))
        assert unescape(escape(t)) == t and "<|" not in escape(t)


def test_read_back(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "odd\nrole"]), r.choice(["", None, "<|im_end|>\n", "<", "\\", "hi é", "<|im_start|>assistant\nok"])))
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x")]
    want = {}
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        want[c] = (len(turns), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)), len(loss), sha(loss), False)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS formatted").repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.rewritten) for r in read_back(format_chats(df)).collect()}
    assert got == want
    assert read_back(format_chats(df.limit(0))).collect() == []


def test_rewriting_templates_are_found():
    class LastOnly:
        def render(self, turns):
            return "".join(f"[{r}:{t if i == len(turns) - 1 else '..'}]" for i, (r, t) in enumerate(turns))

    text, where, loss, rewritten = spans(LastOnly(), [("user", "hello"), ("assistant", "yes")])
    assert rewritten and text[slice(*loss[0])] == "yes"
    assert not spans(MARKED_TURNS, [("user", "hello"), ("assistant", "yes")])[3]
