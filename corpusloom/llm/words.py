"""Words of Arrow string columns as numpy arrays: boundaries, hashes, shingles and winnowed anchors.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and carriage return,
which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are 64-bit and depend on the
word's bytes alone, so every task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SMALL_BYTES = 1 << 18  # where tasks hold tens of numbers for every byte or word
_CHUNK = 1 << 17
_BLANK = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U = np.uint64


def blank_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(_BLANK)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 2 + 12345], U))[0]) | 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.full(n, self.base, U)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=U)
            steps[1:] = U(self.inverse)
            self.down = np.cumprod(steps, dtype=U)
        return self.up, self.down


class Hasher:
    """Hashes of words and word sequences; ``lower`` folds A-Z first, ``seed`` picks one of many functions."""

    def __init__(self, lower: bool = False, seed: int = 0):
        table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
        self.table = table[lower_table()] if lower else table
        self.bytes, self.sequence = Powers(seed), Powers(seed + 1)

    def words(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per word; words are in order and do not overlap."""
        out = np.empty(len(start), U)
        i = 0
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
            size = int(end[j - 1] - base)
            up, down = self.bytes.reach(size + 1)
            sums = np.zeros(size + 1, U)
            np.cumsum(self.table[text[base : base + size]] * up[:size], out=sums[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out)

    def prefix(self, words: np.ndarray) -> np.ndarray:
        up, _ = self.sequence.reach(len(words) + 1)
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return sums

    def sequences(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words ``start[i]`` to ``end[i]`` for each i; ``prefix`` comes from :meth:`prefix`."""
        _, down = self.sequence.reach(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))

    def shingles(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words at every position that has as many behind it."""
        n = max(0, len(words) - k + 1)
        at = np.arange(n)
        return self.sequences(self.prefix(words), at, at + k)


class Words:
    """Words of a slice of texts: ``start`` and ``end`` into ``text``, ``bounds`` delimits each row's words."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.text = text[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        word = ~blank_table()[self.text]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        filled = self.offsets[:-1] < self.offsets[1:]
        heads, tails = self.offsets[:-1][filled], self.offsets[1:][filled] - 1
        first[heads], last[tails] = word[heads], word[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``max_bytes`` of text; a longer single text is a piece of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` consecutive values."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    value, place, size = x, np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    return place


class Anchors:
    """Winnowed anchors: for every window of ``window`` words its leftmost smallest ``k``-word shingle.

    Consecutive windows of a row with the same anchor form one run: ``first`` to ``last`` are its windows'
    places, ``anchor`` is the shingle's hash. Equal windows have equal anchors at equal offsets in any text, so
    two texts can only share a window where they share an anchor. With ``reach`` windows are that long, but choose
    their anchors among their first ``window`` words.
    """

    def __init__(self, hasher: Hasher, hashes: np.ndarray, row: np.ndarray, window: int, k: int, reach: int | None = None):
        reach = reach or window
        self.prefix = hasher.prefix(hashes)
        at = np.arange(max(0, len(hashes) - k + 1))
        grams = hasher.sequences(self.prefix, at, at + k)
        place = window_argmin(grams, window - k + 1)[: max(0, len(hashes) - reach + 1)]
        whole = row[: len(place)] == row[reach - 1 : reach - 1 + len(place)] if len(place) else np.zeros(0, bool)
        windows = np.flatnonzero(whole)
        place, owner = place[windows], row[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        self.first = windows[head]
        self.last = windows[np.append(head[1:], len(windows))[: len(head)] - 1] if len(head) else windows[:0]
        self.row = owner[head]
        self.place = place[head]
        self.anchor = grams[place[head]]
