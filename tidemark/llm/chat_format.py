"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Each prefix of a
conversation is rendered; where the outcome extends the one before, the new part is that turn's
span; where it does not, the template has rewritten history and the conversation is marked so.  The
span of an assistant's text within its turn is found by exchanging the text: the turn is rendered
once more with one unused character in its place, and what stands around that character is the frame.

Turns are sorted within a task and streamed; a conversation is held only while its turns pass, and
conversations share no state.  Turns are ordered by turn (null first), then role and text, so ties
and repeated rows have one result.  A null text or role is empty.  Null conversation ids are one
conversation.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Takes away the meaning of control strings: every '<|' and every backslash gets a mark."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The inverse of escape; a marked n is a line break, as roles have it."""
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out += (text[i:j], "\n" if text[j + 1] == "n" else text[j + 1])
        i = j + 2
    out.append(text[i:])
    return "".join(out)


class MarkedTurns:
    """Each turn: a start mark, the role, a line break, the escaped text, an end mark, a line break."""

    def render(self, turns: list) -> str:
        return "".join(START + escape(role).replace("\n", "\\n") + f"\n{escape(text)}{STOP}\n" for role, text in turns)

    def parse(self, formatted: str) -> list:
        """(role, text, start, end) of each turn, read from the string alone."""
        out, at = [], 0
        while at < len(formatted):
            line = formatted.index("\n", at)
            stop = formatted.index(STOP, line)
            out.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop]), line + 1, stop))
            at = stop + len(STOP) + 1
        return out


MARKED_TURNS = MarkedTurns()


def spans(template, turns: list):
    """(formatted, [(start, end) of each turn], [(start, end) of each assistant text], rewritten)."""
    whole, where, loss, rewritten = "", [], [], False
    for k, (role, said) in enumerate(turns):
        text = template.render(turns[: k + 1])
        grown = text.startswith(whole)
        rewritten |= not grown
        where.append((len(whole) if grown else 0, len(text)))
        if role == "assistant":
            held = set(text)
            probe = next(c for c in map(chr, [*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]) if c not in held)
            frame = template.render([*turns[:k], (role, probe)])
            head = frame.find(probe)
            tail = len(frame) - head - 1
            if head >= 0 and text[:head] == frame[:head] and text[len(text) - tail :] == frame[head + 1 :]:
                loss.append((head, len(text) - tail))
        whole = text
    return whole, where, loss, rewritten


def formatter(template):
    """Arrow mapper over turns in order: one row for each conversation."""

    def run(batches):
        import pyarrow as pa

        fields = [("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_ends", pa.list_(pa.int64())), ("loss_spans", pa.list_(pa.int64())), ("rewritten", pa.bool_())]
        held, out, size = [], [], 0

        def close(conv):
            text, where, loss, rewritten = spans(template, held)
            out.append((conv, text, [e for _, e in where], [x for p in loss for x in p], rewritten))
            held.clear()
            return len(text)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

        last = None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and conv != last:
                    size += close(last)
                    if size > 8 << 20:
                        yield rows()
                        out, size = [], 0
                last = conv
                held.append((role or "", text or ""))
        if held:
            close(last)
        if out:
            yield rows()

    return run


def format_chats(turns: DataFrame, template=MARKED_TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, turn_ends, loss_spans (starts and ends in turn), rewritten."""
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(formatter(template), "conv_id long, formatted string, turn_ends array<bigint>, loss_spans array<bigint>, rewritten boolean")


def reader(template):
    """Arrow mapper: formatted conversations to digests of what they say."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for conv, text, loss, rewritten in zip(*(batch.column(i).to_pylist() for i in range(4))):
                turns = template.parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest()
                masked = "".join(unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2]))
                out.append((conv, len(turns), said, len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text), rewritten))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def read_back(formatted: DataFrame, template=MARKED_TURNS) -> DataFrame:
    """Per conversation: digests of turns and of loss text, parsed from the formatted string."""
    rows = formatted.select("conv_id", "formatted", "loss_spans", "rewritten")
    return rows.mapInArrow(reader(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
