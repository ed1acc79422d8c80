"""Vectorised text kernels: words, hashes and shingles of whole Arrow string columns.

Words are found on UTF-8 bytes. Every step is a NumPy pass over blocks of about `BLOCK` bytes,
cut at document borders or white space, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_B = np.arange(256)
#: Separators of the contracts' words `[^\x20\x09-\x0D]+`.
SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
#: Separators of plain words: all of ASCII but letters and digits. UTF-8 tails belong to words.
NOT_ALNUM = ~(((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128))
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
SAME = _B.astype(np.uint8)
_POW = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        size = max(n, 2 * len(_POW))
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _POW[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, size: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `size` bytes each; a longer text stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray, fold: np.ndarray, limit: int = 0):
    n = len(data)
    gap = sep[data]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    first = ~gap & (before | border[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | border[1:])) + 1
    run = np.cumsum(first)
    place = np.arange(n) - np.concatenate([[0], start])[run]
    place[gap] = 0
    weight = _BYTE[fold[data]]
    weight[gap] = 0
    size = end - start
    if limit:
        weight[place >= limit] = 0
        size = np.minimum(size, limit)
    with np.errstate(over="ignore"):
        weight *= _powers(int(place.max()) + 1)[place]
        hashed = mix(np.add.reduceat(weight, start) + size.astype(np.uint64) * _STEPS[63])
    return hashed, start, end


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER, limit: int = 0):
    """64-bit hashes of all words, their byte starts and ends, and each row's first word (n + 1 entries). limit: hash so many first bytes only."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    parts, a, n = [], 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and not sep[data[b]]:  # ends before white space, however far that is
            gaps = np.flatnonzero(sep[data[b : b + 4096]])
            b = b + int(gaps[0]) if len(gaps) else min(n, b + 4096)
            if len(gaps):
                break
        inside = offs[(offs > a) & (offs < b)] - a
        h, s, e = _words(data[a:b], np.concatenate([[0], inside, [b - a]]), sep, fold, limit)
        parts.append((h, s + a, e + a))
        a = b
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, np.searchsorted(s, offs)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and each row's first one. A row of fewer words has its whole sequence as one; a row without words none."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begin[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            full = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                full += h[i : len(h) - k + 1 + i] * _STEPS[i]
            keep = np.zeros(len(full) + 1, np.int64)
            rows = np.flatnonzero(count >= k)
            np.add.at(keep, first[rows], 1)
            np.add.at(keep, first[rows] + n[rows], -1)
            keep = np.cumsum(keep)[:-1].astype(bool)
            long = np.repeat(count >= k, n)
            out[long] = mix(full[keep])
        for r in np.flatnonzero((count > 0) & (count < k)):
            w = h[first[r] : first[r + 1]]
            out[begin[r]] = mix((w * _STEPS[: len(w)]).sum(dtype=np.uint64) + _STEPS[40 + len(w)])[()]
    return out, begin


def rows_of(begin: np.ndarray) -> np.ndarray:
    """The row of every element."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin))


def distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order."""
    parts = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def strings(column: pa.Array, size: int = 2 * BLOCK):
    """Blocks of rows of a string column: row range, bytes, offsets from 0."""
    data, offs = buffers(column)
    for a, b in blocks(offs, size):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
