"""Hashes of words and sets of word shingles, computed over whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes.
_PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of ASCII-lower-cased words, equal for equal words wherever they stand.

    A word's hash is a polynomial over its bytes in an odd base, modulo 2**64, taken from one running sum over the
    whole piece and shifted back by the inverse power of where the word starts.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(20_240_229)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(ord("A"), ord("Z") + 1):
            self.value[c] = self.value[c + 32]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self._base = int(rng.integers(1, 2**62)) * 4 + 3
        self._grow(_PIECE + 1)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
            return out

        self.power, self.inverse = powers(self._base), powers(pow(self._base, -1, 2**64))

    def words(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words in data (uint8); no word crosses a position in breaks."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= len(self.power):
            self._grow(n + 1)
        inside = ~self.space[data]
        new = np.zeros(n + 1, bool)
        new[breaks] = True
        new[0] = new[n] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        starts = np.flatnonzero(after & (~before | new))
        ends = np.flatnonzero(before & (~after | new))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.power[:n], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]), starts


def text_pieces(column: pa.Array, size: int = _PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about size bytes; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def row_words(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, word offsets of each row, and word starts in data."""
    hashes, starts = hasher.words(data, offsets)
    return hashes, np.searchsorted(starts, offsets), starts


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; all words as one run if there are fewer; empty if none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = total * _ODD + words[i : len(words) - k + 1 + i]
    return np.unique(mix(total + np.uint64(k)))
