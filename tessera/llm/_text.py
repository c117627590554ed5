"""Vectorised word handling on Arrow string buffers (NumPy only, no Spark).

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as ``[^\\x20\\x09-\\x0D]+`` on code points.  Hashes are 64-bit
polynomial hashes of the word's bytes (whole word, any length) passed through a
finaliser, so equal words have equal hashes on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\v\f\r"
#: a little under a power of two, to which tables of powers grow
CHUNK_BYTES = (2 << 20) - 64

_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_QINV = pow(_Q, -1, 1 << 64)
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _M64], dtype=np.uint64))[0])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of an odd base modulo 2**64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = pow(self.base, len(self.table), 1 << 64)
            self.table = np.concatenate([self.table, self.table * np.uint64(step)])
        return self.table[:n]


_POW_P, _POW_PI, _POW_Q, _POW_QI = _Powers(_P), _Powers(_PINV), _Powers(_Q), _Powers(_QINV)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """uint64 hash of the bytes of every span; `lower` folds A-Z."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    values = _BYTE[_LOWER[raw]] if lower else _BYTE[raw]
    values *= _POW_P.upto(n)
    np.cumsum(values, out=sums[1:])
    h = sums[ends] - sums[starts]
    h *= _POW_PI.upto(n + 1)[starts]
    return mix(h)


class Words:
    """Words of consecutive documents.

    starts, ends: byte positions in `raw`; first: for document k its words are
    first[k]:first[k + 1]; doc: the document of each word.  `separators`: 256 flags.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> None:
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        word = ~separators[raw]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        finish = word.copy()
        finish[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = word[inner]
        finish[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """uint64 hash of every word; `lower` folds A-Z."""
        return span_hashes(self.raw, self.starts, self.ends, lower)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items; result i covers items i..i+k-1 (may cross documents)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        out = hashes[: n - k + 1].copy()
        for j in range(1, k):
            out *= np.uint64(_Q)
            out += hashes[j : n - k + 1 + j]
        return mix(out)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _POW_Q.upto(n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _POW_QI.upto(n)[: n - k + 1])


def gram_starts(words: Words, k: int) -> np.ndarray:
    """Word indices at which a k-gram inside one document starts."""
    left = words.first[1:][words.doc] - np.arange(len(words))
    return np.flatnonzero(left >= k)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over a string column in chunks of bounded bytes."""
    raw, offsets = buffers(column)
    for i, j in chunks(offsets, limit):
        a, b = offsets[i], offsets[j]
        yield i, j, Words(raw[a:b], offsets[i : j + 1] - a)
