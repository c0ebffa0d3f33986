"""SentencePiece encoding by Unigram Viterbi over a double-array trie, and decoding.

Pieces come from a public model file; no tokenizer is trained.  If the file's scores are log
probabilities they are taken as they are.  A file of merge ranks (whole numbers) holds none, so log
scores are made from the ranks alone by Zipf's law: ``ln p = -ln(1 + rank) - ln(sum of 1 / (1 + rank))``.

A text gets a space in front, spaces are whitespace markers, and no other normalisation is done, so
decoding gives the text back exactly.  A character that no piece spells becomes its bytes; so does a
marker character that the text itself holds.  The score of such a character is the lowest score less
ten.  Of paths with equal scores the one whose last piece starts first wins, at each place.

If no piece holds a line break, or a marker behind another character, texts are cut there without
changing the best path; this is tested when a file is loaded, and texts are not cut if it fails.
Each distinct part is segmented once in a task: short parts all at once, column by column, long ones
one by one with a path that is written out as soon as all open paths share it.  The memory for parts
is bounded, batches are worked through by ``CHUNK`` bytes of text (or one text), and only the ids of
one text are held whole.  Nothing is shuffled; the trie (a few MB, fixed by the file) is broadcast.

A null or empty text has no tokens.  Null ids are kept.  Repeated rows give repeated results, other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import row_chunks, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts that a task remembers, bytes up to which parts are segmented together, bytes of text at a time.
REMEMBER, SHORT, CHUNK = 300_000, 64, 4 << 20


def log_scores(scores: list) -> list:
    """Log probabilities as they are; merge ranks (all whole numbers) by Zipf's law."""
    import math

    if any(s != int(s) for s in scores):
        return scores
    total = math.log(math.fsum(1 / (1 - s) for s in scores))
    return [-math.log(1 - s) - total for s in scores]


def load_pieces(path: str = MODEL):
    """[(piece's bytes, log score)] of ordinary pieces by id (None for others) and the 256 byte pieces' ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list = [None] * sp.get_piece_size()
    raw = [0] * 256
    plain = []
    for i in range(len(pieces)):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw[int(text[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain.append((i, text.encode(), float(sp.get_score(i))))
    for (i, text, _), score in zip(plain, log_scores([x[2] for x in plain])):
        pieces[i] = (text, score)
    return pieces, raw


def may_cut(pieces: list) -> bool:
    """Whether no piece reaches over a line break or holds a marker behind another character."""
    texts = [p[0].decode() for p in pieces if p]
    return not any("\n" in t or MARK in t.lstrip(MARK) for t in texts)


def double_array(pieces: list):
    """(base, check, value) arrays; child of state s by byte c is base[s] + c + 1 if check says s."""
    import numpy as np

    root: dict = {}
    for i, p in enumerate(pieces):
        if p is not None:
            node = root
            for c in p[0]:
                node = node.setdefault(c, {})
            node[-1] = i
    order, todo = [], [("", root)]
    states: dict = {"": 0}
    for name, node in todo:
        keys = sorted(c for c in node if c >= 0)
        if keys:
            order.append((name, node, keys))
        todo += [(name + chr(c), node[c]) for c in keys]
    size = 4 * len(todo) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    # nodes in breadth-first order, so a parent's state is known; single children fill the gaps
    wide = lone = 1
    for name, node, keys in order:
        state = states[name]
        if len(keys) == 1:
            while check[lone] != -1 or lone <= keys[0]:
                lone += 1
            at = lone - keys[0] - 1
        else:
            at = max(0, wide - keys[0] - 1)
            tries = 0
            while any(check[at + c + 1] != -1 for c in keys):
                at, tries = at + 1, tries + 1
            if tries > 50:
                wide = at + keys[0] + 1
        base[state] = at
        for c in keys:
            t = at + c + 1
            check[t], states[name + chr(c)] = state, t
            value[t] = node[c].get(-1, -1)
        if at + 1000 > size:
            base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
    top = max(t for t in range(size) if check[t] != -1) + 300
    return tuple(np.array(x[:top], np.int32) for x in (base, check, value))


class Codec:
    """Encodes and decodes with one trie; keeps the segmentation of parts it has met."""

    def __init__(self, pieces, raw, trie):
        import re

        import numpy as np

        self.trie = trie
        self.base, self.check, self.value = (x.tolist() for x in trie)
        self.score = [p[1] if p else 0.0 for p in pieces]
        self.scores = np.array(self.score)
        self.raw = raw
        self.raws = np.array(raw, np.uint32)
        self.unknown = min(p[1] for p in pieces if p) - 10.0
        mark = MARK.encode()
        self.spell = [p[0].replace(mark, b" ") if p else b"" for p in pieces]
        for c, i in enumerate(raw):
            self.spell[i] = bytes([c])
        self.parts = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}" if may_cut(pieces) else f"[^{MARK}]+|{MARK}")
        self.width = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])
        self.known: dict = {}

    def learn(self, lists: list) -> None:
        """Segments all parts in ``lists`` that are not known yet."""
        every: set = set()
        for parts in lists:
            every.update(parts)
        new = [p for p in every if p not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, every
        short = []
        for p in new:
            text = p.replace(" ", MARK).encode()
            if p == MARK:
                self.known[p] = self.raws[list(text)].astype("<u4").tobytes()
            elif len(text) <= SHORT:
                short.append((len(text), text, p))
            else:
                self.known[p] = self.segment(text)
        short.sort(key=lambda x: -x[0])
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            self.known.update(zip([x[2] for x in some], self.segment_all([x[1] for x in some])))

    def segment_all(self, texts: list) -> list:
        """Ids of the best segmentation of each of some short byte strings, the longest first."""
        import numpy as np

        base, check, value = self.trie
        n, longest = np.array([len(t) for t in texts]), len(texts[0])
        data = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(len(texts), longest).T.astype(np.int32)
        longer = np.searchsorted(-n, -np.arange(longest + 1), "left")  # texts of more than j bytes come first
        best = np.full((longest + 1, len(texts)), -np.inf)
        best[0] = 0.0
        start = np.zeros((longest + 1, len(texts)), np.int16)
        piece = np.full((longest + 1, len(texts)), -1, np.int32)
        for i in range(longest):
            rows = np.flatnonzero(best[i, : longer[i]] > -np.inf)
            width = self.width[data[i, rows]]
            spelt = np.zeros(len(rows), bool)
            at, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, longest):
                who = rows[at]
                if j > i:
                    here = who < longer[j]
                    at, state, who = at[here], state[here], who[here]
                to = base[state] + data[j, who] + 1
                ok = check[to] == state
                at, state, who = at[ok], to[ok], who[ok]
                if not len(at):
                    break
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    v, r, k = v[hit], who[hit], at[hit]
                    s = best[i, r] + self.scores[v]
                    spelt[k] |= width[k] == j + 1 - i
                    up = s > best[j + 1, r]
                    r = r[up]
                    best[j + 1, r], start[j + 1, r], piece[j + 1, r] = s[up], i, v[up]
            lone = np.flatnonzero(~spelt)
            r, e = rows[lone], i + width[lone]
            s = best[i, r] + self.unknown
            up = s > best[e, r]
            r, e = r[up], e[up]
            best[e, r], start[e, r], piece[e, r] = s[up], i, -1
        where, first, end, ids = [], [], n, []
        row, end = np.arange(len(texts)), n
        while len(row):
            where.append(row), first.append(start[end, row].astype(np.int64)), ids.append(piece[end, row])
            row, end = row[first[-1] > 0], first[-1][first[-1] > 0]
        where, first, ids = (np.concatenate(x) for x in (where, first, ids))
        order = np.lexsort((first, where))
        where, first, ids = where[order], first[order], ids[order]
        size = np.where(ids >= 0, 1, self.width[data[first, where]])
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        where, first, ids = (np.repeat(x, size) for x in (where, first, ids))
        ids = np.where(ids >= 0, ids, self.raws[data[first + step * (ids < 0), where]]).astype("<u4").tobytes()
        cut = np.searchsorted(where, np.arange(len(texts) + 1)) * 4
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def segment(self, text: bytes) -> bytes:
        """Ids of the best segmentation of one byte string of any length."""
        from array import array

        base, check, value, score, raw = self.base, self.check, self.value, self.score, self.raw
        best, back, done = {0: 0.0}, {}, 0
        out = array("I")

        def settle(ends) -> int:
            """Writes out what all paths to ``ends`` share; returns where that stops."""
            ends = set(ends)
            while len(ends) > 1:
                far = max(ends)
                ends.remove(far)
                ends.add(back[far][0])
            stop = e = ends.pop()
            ids: list = []
            while e > done:
                i, v = back[e]
                ids += [v] if v >= 0 else [raw[c] for c in reversed(text[i:e])]
                e = i
            out.extend(reversed(ids))
            return stop

        for i in range(len(text)):
            b = best.pop(i, None)
            if b is None:
                continue
            c = text[i]
            width = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            state, single = 0, False
            for j in range(i, len(text)):
                t = base[state] + text[j] + 1
                if check[t] != state:
                    break
                state = t
                v = value[t]
                if v >= 0:
                    s, e = b + score[v], j + 1
                    single |= e - i == width
                    if e not in best or s > best[e]:
                        best[e], back[e] = s, (i, v)
            if not single:
                e, s = i + width, b + self.unknown
                if e not in best or s > best[e]:
                    best[e], back[e] = s, (i, -1)
            if len(back) > 1 << 16:
                done = settle(best)
                back = {e: x for e, x in back.items() if e > done}
        settle([len(text)])
        return out.tobytes()

    def encode_all(self, texts: list) -> list:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            if len(text) <= CHUNK:
                parts = self.parts.findall(" " + text) if text else []
                out.append(parts)
            else:  # its parts are not held all at once
                found, ids = self.parts.finditer(" " + text), []
                while some := [m[0] for m, _ in zip(found, range(1 << 18))]:
                    self.learn([some])
                    ids.append(b"".join(map(self.known.__getitem__, some)))
                out.append(b"".join(ids))
        self.learn([parts for parts in out if not isinstance(parts, bytes)])
        return [x if isinstance(x, bytes) else b"".join(map(self.known.__getitem__, x)) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        """UTF-8 text of the ids: markers become spaces and the one in front goes."""
        return b"".join(map(self.spell.__getitem__, ids))[1:]


def shared_codec(spark, path: str):
    pieces, raw = load_pieces(path)
    return spark.sparkContext.broadcast((pieces, raw, double_array(pieces)))


def digests(shared, names: list, tokens: bool):
    """Arrow mapper: the last column is the text, the others are kept."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        codec = Codec(*shared.value)
        is_raw = np.zeros(len(codec.score), bool)
        is_raw[codec.raws] = True
        for batch in row_chunks(batches, -1, CHUNK):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            out, held = [], []
            for text, code in zip(texts, codec.encode_all(texts)):
                ids = np.frombuffer(code, "<u4")
                back = codec.decode(ids.tolist())
                out.append((len(ids), int(is_raw[ids].sum()), hashlib.sha256(code).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
                if tokens:
                    held.append(ids)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            cols += [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            if tokens:
                cut = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(held).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names)
            trim()

    return run


def encode_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, tokens: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256, round_trip (and token_ids)."""
    shared = shared_codec(documents.sparkSession, model)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["token_ids"] * tokens
    return docs.mapInArrow(digests(shared, names, tokens), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", token_ids array<int>" * tokens)
