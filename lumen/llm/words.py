"""Vectorised word work over Arrow text columns: boundaries, 64-bit hashes, normalised bytes.

Everything here runs over the bytes of many texts at once, so that no Python
code runs per word.  ``slices`` bounds the bytes handled at once; a text longer
than the bound is handled alone and whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that no letter-or-digit word holds: ASCII other than 0-9, A-Z, a-z.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batch with the bytes of its text column and each text's offsets; nulls are empty."""
    col = batch.column(column).fill_null("") if batch.column(column).null_count else batch.column(column)
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if not len(col):
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(col))
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of some texts: ``start``, ``end`` (bytes), and ``first``, the index of each text's first word with one entry more than texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        w = ~separators[data]
        begin, stop = w.copy(), w.copy()
        begin[1:] &= ~w[:-1]
        stop[:-1] &= ~w[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begin[edges] = w[edges]
        stop[edges - 1] = w[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in which words follow each other with one space after each, and each word's start there."""
        size = self.end - self.start + 1
        at = np.cumsum(size) - size
        step = np.ones(int(size.sum()), np.int64)
        if len(at):
            step[0] = self.start[0]
            step[at[1:]] = self.start[1:] - self.end[:-1]
        index = np.cumsum(step, out=step)
        padded = np.concatenate([self.data, np.full(1, 32, np.uint8)])
        out = padded[index]
        out[at + size - 1] = 32
        return out, at

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_slices(self.data, self.start, self.end - self.start, seed)


def hash_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte slices."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = size.astype(np.int64)
    h = mix(size.astype(U) * _M1 + U(seed))
    rows, k = None, 0
    while True:
        s, z = (start, size) if rows is None else (start[rows], size[rows])
        rest = np.minimum(z - k, 8)
        v = at[s + k] & (~U(0) >> ((U(8) - rest.astype(U)) * U(8)))
        if rows is None:
            h = mix(h ^ v) * _M1
        else:
            h[rows] = mix(h[rows] ^ v) * _M1
        k += 8
        rows = np.flatnonzero(size > k) if rows is None else rows[z > k]
        if not len(rows):
            return h


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries of h, in order; texts' borders are the caller's matter."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for j in range(n):
        out = out * _M1 + mix(h[j : j + m])
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Starts of windows of n words that lie within one text."""
    size = np.diff(first)
    full = np.maximum(size - n + 1, 0)
    return np.repeat(first[:-1], full) + np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i]+size[i]-1, one slice after another."""
    size = size.astype(np.int64)
    total = int(size.sum())
    out = np.ones(total, np.int64)
    keep = size > 0
    s, z = start[keep].astype(np.int64), size[keep]
    if total:
        at = np.cumsum(z) - z
        out[0] = s[0]
        out[at[1:]] = s[1:] - (s[:-1] + z[:-1] - 1)
        np.cumsum(out, out=out)
    return out
