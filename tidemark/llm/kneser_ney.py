"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs.

1. Words of the training texts are counted: each task pre-aggregates and deals (hash, count) by
   range of the hash.  The sorted ranges are the vocabulary; a word's place in it is its number.
2. Pairs of numbers are counted the same way, dealt by a hash of the pair, so neither a frequent
   word nor a frequent pair meets in one task.  Each range is stored as a sorted hash array with
   its counts, and tells how many words precede or follow each word.
3. Those sums are added by range of the word and stored beside the vocabulary.
4. Scoring maps the arrays from the shared folder into memory, so workers of one machine hold one
   copy, and looks sorted batches of pairs up in them.  Nothing is shuffled there.

Discounts for counts 1, 2 and 3 or more are the usual closed forms, of pairs at the upper level and
of the numbers of different predecessors at the lower; the lower level is interpolated with the
uniform distribution over the vocabulary and one unknown word.  An end token follows each text's
words; a begin token is a context only.

The arrays must lie in a folder that driver and executors mount under one path (a ``file:`` URI in
spark.checkpoint.dir).  A null text is empty, and a null id belongs to the training fold.  Repeated
rows count each.  Other columns are ignored; without training rows all probabilities are 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, pack, shared_dir, split_rows, stacked, unpack
from .textops import Words, scramble, text_chunks

END_KEY = (1 << 64) - 1


def save(path: str, name: str, arrays: dict) -> None:
    """Writes arrays so that a repeated or lost task leaves no half file."""
    import os
    import uuid

    import numpy as np

    for key, a in arrays.items():
        part = f"{path}/.{uuid.uuid4().hex}.npy"
        np.save(part, a)
        os.replace(part, f"{path}/{name}.{key}.npy")


class Arrays:
    """Sorted hash ranges of one kind, mapped into memory; ranges part the 64-bit hashes evenly."""

    def __init__(self, path: str, kind: str, ranges: int, names: tuple, empty: int = 0):
        import os

        import numpy as np

        self.ranges, self.parts, self.first = ranges, [], [0]
        for r in range(ranges):
            there = os.path.exists(f"{path}/{kind}{r}.{names[0]}.npy")
            self.parts.append([np.load(f"{path}/{kind}{r}.{n}.npy", mmap_mode="r") if there else np.zeros(0, np.uint64) for n in names])
            self.first.append(self.first[-1] + len(self.parts[-1][0]))

    def find(self, keys):
        """For sorted keys: (found, range, place within the range)."""
        import numpy as np

        r = range_of(keys, self.ranges)
        cut = np.searchsorted(r, np.arange(self.ranges + 1))
        place, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for i in range(self.ranges):
            lo, hi = cut[i], cut[i + 1]
            a = self.parts[i][0]
            if lo < hi and len(a):
                p = np.searchsorted(a, keys[lo:hi])
                p[p == len(a)] = 0
                found[lo:hi] = a[p] == keys[lo:hi]
                place[lo:hi] = p
        return found, r, place

    def take(self, column: int, r, place, found):
        """Values of a column at sorted places, 0 where nothing was found."""
        import numpy as np

        out = np.zeros(len(r), np.int64)
        cut = np.searchsorted(r, np.arange(self.ranges + 1))
        for i in range(self.ranges):
            lo, hi = cut[i], cut[i + 1]
            if lo < hi and len(self.parts[i][0]):
                out[lo:hi] = np.where(found[lo:hi], self.parts[i][column][place[lo:hi]], 0)
        return out


def range_of(keys, ranges: int):
    """Which of the even ranges a 64-bit key lies in."""
    import numpy as np

    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def token_keys(words, ids, offsets, data):
    """(keys of all tokens with an end token after each text, index of each text's first)."""
    import numpy as np

    starts, ends, low = words.find(offsets, data)
    h = np.minimum(words.hashes(starts, ends, low), np.uint64(END_KEY - 1))
    first = words.per_text(offsets, starts)
    out = np.insert(h, first[1:], np.uint64(END_KEY))
    return out, first + np.arange(len(first))


def word_counts(ranges: int):
    """Arrow mapper: training texts to (range, block of word hashes and counts)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = Words("space")
        for batch in batches:
            keys = [np.unique(token_keys(words, *chunk)[0], return_counts=True) for chunk in text_chunks([batch])]
            if not keys:
                continue
            k, c = summed(np.concatenate([x[0] for x in keys]), np.concatenate([x[1] for x in keys]))
            rows = list(split_rows(range_of(k, ranges), [k, c.astype(np.uint32)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])

    return run


def summed(keys, counts):
    """Sorted distinct keys and the sum of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts, cut) if len(keys) else counts


def store_words(path: str):
    """Group function: one range of the vocabulary; returns its size and its tokens."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        r = table.column("part")[0].as_py()
        k, c = summed(*stacked(table.column("block").to_pylist(), 2, [np.uint64, np.uint32]))
        save(path, f"word{r}", {"count": c, "key": k})
        return pa.table({"part": pa.array([r], pa.int32()), "words": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    return run


def numbered(vocabulary, keys):
    """(number of each key, -1 if unknown; its count)."""
    import numpy as np

    distinct, back = np.unique(keys, return_inverse=True)
    found, r, place = vocabulary.find(distinct)
    number = np.where(found, np.array(vocabulary.first)[r] + place, -1)
    return number[back], vocabulary, (distinct, back, found, r, place)


def pair_counts(path: str, words_ranges: int, ranges: int):
    """Arrow mapper: training texts to (range, block of pairs and counts)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = Words("space")
        vocabulary = Arrays(path, "word", words_ranges, ("key",))
        begin = vocabulary.first[-1]
        for batch in batches:
            found = []
            for chunk in text_chunks([batch]):
                keys, first = token_keys(words, *chunk)
                number = numbered(vocabulary, keys)[0]
                before = np.r_[begin, number[:-1]]
                before[first[:-1]] = begin
                found.append(np.unique((before << 32 | number).astype(np.uint64), return_counts=True))
            if not found:
                continue
            k, c = summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            rows = list(split_rows(range_of(scramble(k), ranges), [k, c.astype(np.uint32)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])

    return run


def store_pairs(path: str, edges: list):
    """Group function: one range of the pairs; returns blocks of what it says of each word."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        r = table.column("part")[0].as_py()
        k, c = summed(*stacked(table.column("block").to_pylist(), 2, [np.uint64, np.uint32]))
        h = scramble(k)
        order = np.argsort(h)
        top = int(c.max()) if len(c) else 0
        save(path, f"pair{r}", {"count": c[order].astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32), "key": h[order]})
        before, after = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = []
        size = np.minimum(c, 3)
        # columns: word, predecessors, successors seen once, twice, more often
        word = np.concatenate([after, before])
        what = np.concatenate([np.zeros(len(k), np.int64), size])
        u, n = np.unique(word << 2 | what, return_counts=True)
        rows = [(1, *x) for x in split_rows(np.searchsorted(edges, u >> 2, "right") - 1, [u, n.astype(np.uint32)])]
        for i in range(1, 5):
            rows.append((2, i, pack([np.array([int((c == i).sum())])])))
        return pa.table({"kind": pa.array([x[0] for x in rows], pa.int32()), "part": pa.array([x[1] for x in rows], pa.int32()), "block": pa.array([x[2] for x in rows], pa.binary())})

    return run


def store_sides(path: str, edges: list):
    """Group function: adds what the pairs say of one range of words, or one count of counts."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        if kind == 2:
            total = [part, sum(int(unpack(b)[0][0]) for b in blocks), 0, 0, 0, 0]
        else:
            u, n = summed(*stacked(blocks, 2, [np.int64, np.uint32]))
            size = int(edges[part + 1] - edges[part])
            sides = np.zeros((4, size), np.uint32)
            sides[u & 3, (u >> 2) - edges[part]] = n
            save(path, f"side{part}", {"all": np.ascontiguousarray(sides.T)})
            pre = sides[0]
            total = [0, 0, *(int((pre == i).sum()) for i in range(1, 5))]
        return pa.table({n: pa.array([x], pa.int64()) for n, x in zip(("order", "pairs", "p1", "p2", "p3", "p4"), total)})

    return run


def discounts(n: list) -> list:
    """[0, D1, D2, D3+] from the numbers of entries that occur once, twice, three and four times.

    At least 0.05 each, so that unseen words keep some probability in degenerate corpora.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else out[-1]
        out.append(min(max(d, 0.05), float(k)))
    return out


def scorer(path: str, words_ranges: int, ranges: int, edges: list, total: int, texts: int, upper: list, lower: list, pairs: int, rest: float):
    """Arrow mapper: (id, held out, text) to the result row of each text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = Words("space")
        vocabulary = Arrays(path, "word", words_ranges, ("key", "count"))
        pair_arrays = Arrays(path, "pair", ranges, ("key", "count"))
        sides = [np.load(f"{path}/side{r}.all.npy", mmap_mode="r") for r in range(len(edges) - 1)] if pairs else []
        v = vocabulary.first[-1]
        up, down = np.array(upper), np.array(lower)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            at = 0
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], ["i", "text"])
            for chunk in text_chunks([rows], 4 << 20):
                keys, first = token_keys(words, *chunk)
                number, _, (distinct, back, found, r, place) = numbered(vocabulary, keys)
                count = vocabulary.take(1, r, place, found)
                # what is known of each distinct word, in the order of the vocabulary
                mine = np.zeros((len(distinct), 4), np.int64)
                ids = np.where(found, np.array(vocabulary.first)[r] + place, -1)
                for i, side in enumerate(sides):
                    here = np.flatnonzero((ids >= edges[i]) & (ids < edges[i + 1]))
                    mine[here] = side[ids[here] - edges[i]]
                base = np.log10((count + 0.5) / (total + 0.5 * (v + 1)))
                pre = mine[:, 0]
                low = rest / (v + 1) + np.maximum(pre - down[np.minimum(pre, 3)], 0) / max(pairs, 1)
                left = mine[:, 1:] @ up[1:] / np.maximum(count, 1)
                before = np.r_[v, number[:-1]]
                before[first[:-1]] = v
                context_count, context_left = np.r_[0, count[back][:-1]], np.r_[0.0, left[back][:-1]]
                if sides:
                    start = sides[-1][v - edges[-2]][1:].astype(np.int64)
                    context_left[first[:-1]] = start @ up[1:] / max(texts, 1)
                context_count[first[:-1]] = texts
                both = np.flatnonzero((before >= 0) & (number >= 0) & (context_count > 0))
                h = scramble((before[both] << 32 | number[both]).astype(np.uint64))
                order = np.argsort(h)
                seen = np.zeros(len(h), np.int64)
                f, hr, hp = pair_arrays.find(h[order])
                seen[order] = pair_arrays.take(1, hr, hp, f)
                c = np.zeros(len(keys), np.int64)
                c[both] = seen
                tail = low[back]
                known = context_count > 0
                p = np.where(known, np.maximum(c - up[np.minimum(c, 3)], 0) / np.maximum(context_count, 1) + context_left * tail, tail)
                cut = first[:-1]
                out = [np.diff(first), np.add.reduceat((count[back] > 0).astype(np.int64), cut), np.full(len(cut), total), np.add.reduceat(base[back], cut), np.add.reduceat(np.log10(p), cut)]
                n = len(chunk[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *(pa.array(x) for x in out)], names)
                at += n

    return run


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import os
    from urllib.parse import urlparse

    spark = documents.sparkSession
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("the model's arrays need a shared folder that is mounted (file: URI in spark.checkpoint.dir)")
    path = place.path
    os.makedirs(path)
    train = docs.where(~F.col("held_out")).select(F.lit(0).cast("long").alias("i"), "text")
    ranges = bucket_count(documents, 8 << 20)
    vocab = train.mapInArrow(word_counts(ranges), "part int, block binary").groupBy("part").applyInArrow(store_words(path), "part int, words long, tokens long").collect()
    sizes = {r.part: r.words for r in vocab}
    texts_end = sum(r.tokens for r in vocab)
    first = [0]
    for r in range(ranges):
        first.append(first[-1] + sizes.get(r, 0))
    v = first[-1]
    if v >= (1 << 32) - 1:
        raise ValueError("more than 2**32 - 2 different words")
    texts = train.count()
    edges = [v * i // ranges for i in range(ranges)] + [v + 1] if v else [0, 1]
    edges = sorted(set(edges))
    pairs = train.mapInArrow(pair_counts(path, ranges, ranges), "part int, block binary").groupBy("part").applyInArrow(store_pairs(path, edges), "kind int, part int, block binary")
    stats = pairs.groupBy("kind", "part").applyInArrow(store_sides(path, edges), "order long, pairs long, p1 long, p2 long, p3 long, p4 long").collect()
    upper = discounts([sum(r.pairs for r in stats if r.order == i) for i in range(1, 5)])
    pre = [sum(r[f"p{i}"] for r in stats) for i in range(1, 5)]
    lower = discounts(pre)
    n_pairs, three = predecessors(path, edges, spark) if v else (0, 0)
    rest = (lower[1] * pre[0] + lower[2] * pre[1] + lower[3] * three) / n_pairs if n_pairs else 1.0
    return docs.mapInArrow(scorer(path, ranges, ranges, edges, texts_end, texts, upper, lower, n_pairs, rest), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def predecessors(path: str, edges: list, spark) -> tuple:
    """(number of different pairs, number of words with three or more predecessors)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.column(0).to_pylist():
                x = np.load(f"{path}/side{r}.all.npy", mmap_mode="r")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([int(x.sum(dtype=np.int64))]), pa.array([int((x > 2).sum())])], ["n", "three"])

    r = spark.range(len(edges) - 1).mapInArrow(run, "n long, three long").agg(F.sum("n"), F.sum("three")).first()
    return int(r[0] or 0), int(r[1] or 0)
