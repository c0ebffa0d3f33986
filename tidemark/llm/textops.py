"""Vectorised words, word hashes and byte ranges over Arrow string columns."""

from __future__ import annotations


def trim() -> None:
    """Gives freed memory back to the system; reused workers would hold it between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def row_chunks(batches, text_at: int, limit: int = 4 << 20):
    """The same rows in batches of about ``limit`` bytes of text, or one row; bounds a mapper's memory whatever batches Spark sends."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def text_chunks(batches, limit: int = 1 << 20):
    """Yields (ids, offsets, bytes) of whole texts, about ``limit`` bytes at a time.

    Column 0 is a non-null long id, column 1 a string; a null text counts as empty.  A text
    longer than ``limit`` makes a chunk of its own.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        text = batch.column(1)
        if text.null_count:
            text = pc.fill_null(text, pa.scalar("", text.type))
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        _, offsets, data = text.buffers()
        o = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
            yield ids[at:end], o[at : end + 1] - o[at], raw[o[at] : o[end]]
            at = end
        trim()


def separators(kind: str):
    """256 flags: True where a byte belongs to a word, after A-Z became a-z."""
    import numpy as np

    word = np.ones(256, bool)
    if kind == "space":
        word[[0x20, 9, 10, 11, 12, 13]] = False
    else:  # letters and digits
        word[:0x80] = False
        word[0x30:0x3A] = word[0x61:0x7B] = True
    return word


class Words:
    """Finds the words of a chunk and hashes each to 64 bits."""

    def __init__(self, kind: str, size: int = 1 << 20):
        import numpy as np

        self.word = separators(kind)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        mix = np.random.Generator(np.random.PCG64(20240611)).integers(1 << 63, size=256, dtype=np.uint64)
        self.table = mix * np.uint64(2) + np.uint64(1)
        self.grow(size)

    def grow(self, size: int) -> None:
        import numpy as np

        base = 0x9E3779B97F4A7C15
        self.power = np.full(size + 1, base, np.uint64)
        self.inverse = np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
        self.power[0] = self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def find(self, offsets, data):
        """(starts, ends, lower-cased bytes) of all words; none crosses a text's edge."""
        import numpy as np

        low = self.lower[data]
        inside = self.word[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1, low

    def hashes(self, starts, ends, low):
        """A 64-bit hash of each word's bytes."""
        import numpy as np

        if len(low) >= len(self.power):
            self.grow(2 * len(low))
        run = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(self.table[low] * self.power[: len(low)], out=run[1:])
        return scramble((run[ends] - run[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, offsets, starts):
        """Index of the first word of each text, and of the end."""
        import numpy as np

        return np.searchsorted(starts, offsets)


def scramble(x):
    """A bijective 64-bit finaliser."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(hashes, width: int):
    """A hash of each run of ``width`` consecutive word hashes."""
    import numpy as np

    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = scramble(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def ranges(starts, sizes):
    """The concatenation of arange(start, start + size)."""
    import numpy as np

    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
