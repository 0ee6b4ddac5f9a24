"""Vectorised word segmentation and window hashes over Arrow string batches.

Everything works on the UTF-8 bytes of many documents at once.  A separator
table maps each byte to 0 (separator) or to the byte that counts (for folding
case).  All bytes from 0x80 up belong to non-ASCII characters and are word
bytes in every table used here, so byte-wise and character-wise splitting agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _M)


def table(separators: bytes, fold: bool = False) -> np.ndarray:
    """Byte map: 0 for separators and NUL, lower case for A-Z if fold."""
    t = np.arange(256, dtype=np.uint8)
    if fold:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


#: [^\x20\x09-\x0D]+ ; NUL is a word character there, and is mapped to 0xFF, which UTF-8 never holds.
SPACED = table(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACED[0] = 0xFF
#: lower-cased [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    a = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    if a.null_count:
        a = pc.fill_null(a, "")
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most ``most`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            limit = most + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of some texts: byte spans in ``data``, ``first`` (words before each text, and in all), and 64-bit hashes."""

    def __init__(self, strings: pa.Array, tab: np.ndarray):
        self.data, self.offsets = utf8(strings)
        self.mapped = tab[self.data]
        inside = self.mapped != 0
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edge] = False
        after[edge - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._inside = inside
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if not len(self.starts):
                self._hash = np.zeros(0, U64)
                return self._hash
            lengths = self.ends - self.starts
            begin = np.zeros(len(lengths), np.int64)
            np.cumsum(lengths[:-1], out=begin[1:])
            power = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, U64))
            place = np.arange(int(begin[-1] + lengths[-1])) - np.repeat(begin, lengths)
            self._hash = mix(np.add.reduceat(_BYTE[self.mapped[self._inside]] * power[place], begin) + lengths.astype(U64) * _M)
        return self._hash

    def prefix_hash(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes."""
        lengths = np.minimum(self.ends - self.starts, size)
        h = np.zeros(len(lengths), U64)
        for i in range(size):
            there = lengths > i
            h[there] = mix(h[there] + _BYTE[self.mapped[self.starts[there] + i]])
        return mix(h + U64(size))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def fits(self, k: int) -> np.ndarray:
        """For each start of a k-word window over all words: whether it ends in the same text."""
        n = max(0, len(self.starts) - k + 1)
        ends = np.repeat(self.first[1:], self.counts)[:n]
        return np.arange(n) + k <= ends

    def word(self, i: int) -> bytes:
        return self.mapped[self.starts[i] : self.ends[i]].tobytes()


def double(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows from hashes of their first part and of the part that starts ``step`` words on."""
    n = max(0, len(h) - step)
    return mix(mix(h[:n]) * _M + h[step : step + n]) if n else np.zeros(0, U64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, by doubling: length 2n or less from two windows of length n."""
    length = 1
    while length < k:
        step = min(length, k - length)
        h = double(h, step)
        length += step
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values."""
    length = 1
    while length < w:
        step = min(length, w - length)
        n = max(0, len(h) - step)
        h = np.minimum(h[:n], h[step : step + n])
        length += step
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
