"""Vectorised tokenising and hashing of UTF-8 text held in Arrow columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are part of a word: all but space and \t..\r.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LONG_WORD = 64
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection on 64 bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _C2
    x ^= x >> U(27)
    x *= _C3
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split rows into runs of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    raw, off = buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of a run of texts: ``start``/``end`` byte positions, 64-bit ``hash``, ``first[d]:first[d+1]`` the words of text d."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, keep: np.ndarray = SPACED):
        self.raw, self.off = LOWER[raw], off
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = keep[self.raw]
        step = np.diff(inside)
        begins, ends = step[:-1] > 0, step[1:] < 0
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        if len(cuts):  # a word never spans two texts
            here = inside[1:-1].view(bool)
            begins[cuts] |= here[cuts]
            ends[cuts - 1] |= here[cuts - 1]
        self.start = np.flatnonzero(begins[: len(raw)]) if len(raw) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(ends) + 1 if len(raw) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        out = mix(size.astype(U) * _C1)
        if not len(size):
            return out
        padded = np.concatenate((self.raw, np.zeros(8, np.uint8)))
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        todo = np.arange(len(size))
        at = 0
        while len(todo):
            left = size[todo] - at
            v = eight[self.start[todo] + at]
            short = left < 8
            v[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
            out[todo] = mix((out[todo] ^ v) * _C1 + _C3)
            at += 8
            todo = todo[(left > 8) & (size[todo] <= LONG_WORD)]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.raw[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes (across texts; callers keep those inside one)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(n), U)
    for i in range(n):
        out = mix(out * _C1 + h[i : i + m])
    return out


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes; fewer words: the whole sequence as one; no words: empty."""
    all_of = grams(words.hash, n)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(all_of[a : b - n + 1])
        elif b > a:
            yield grams(words.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, U)
