"""Vectorised word and byte hashing of Arrow string columns; no Spark here.

A chunk is some consecutive documents' UTF-8 bytes with their offsets. Words are
``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so bytes serve as well as code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C1B), np.uint64(0xC2B2AE3D27D4EB53))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int = 0) -> np.ndarray:
    if len(_POW[which]) < n:
        size = max(n, 2 * len(_POW[which]), 256)
        p = np.full(size, _BASE[which], np.uint64)
        p[0] = 1
        _POW[which] = np.multiply.accumulate(p)
    return _POW[which][:n]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    both = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (both[offs[0] : offs[-1]], offs - offs[0]) if len(offs) else (both[:0], np.zeros(1, np.int64))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    data, offs = raw(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n), data[offs[i] : offs[min(j, n)]], offs[i : min(j, n) + 1] - offs[i]
        i = j


class Words:
    """The words of a chunk: ``start``, ``end`` (bytes), ``doc`` (row in the chunk) and ``first`` (n + 1: each document's first word)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        solid = ~SPACE[data]
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        begin = offs[:-1][offs[:-1] < offs[1:]]
        head[begin] = solid[begin]
        stop = offs[1:][offs[:-1] < offs[1:]] - 1
        tail[stop] = solid[stop]
        self.data, self.solid = data, solid
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin, size)
        h = np.add.reduceat(_BYTE[which][self.data[self.solid]] * powers(int(size.max()), which)[at], begin)
        return mix(h + size.astype(np.uint64))


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive entries, by doubling; one per start, ``len(h) - k + 1`` of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, done, shift = None, 1, 0, h
    base = [pow(int(_BASE[which]), i, 2**64) for i in range(k + 1)]
    while True:
        if k & width:
            part = shift[done : len(shift)] if out is not None else shift
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = out[:n] + np.uint64(base[done]) * part[:n]
            done += width
        if done == k:
            return mix(out[: len(h) - k + 1])
        n = len(shift) - width
        shift = shift[:n] + np.uint64(base[width]) * shift[width:]
        width *= 2


def per_document(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted so."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def points(data: np.ndarray) -> np.ndarray:
    """Where the code points of UTF-8 ``data`` begin, and its length at the end."""
    return np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]


def point_hashes(data: np.ndarray, at: np.ndarray, which: int = 1) -> np.ndarray:
    """A 64-bit hash of each code point (``at``: as ``points`` gives them)."""
    if len(at) == len(data) + 1:
        return _BYTE[which][data]
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    return np.add.reduceat(_BYTE[which][data] * powers(4, which)[place], at[:-1])
