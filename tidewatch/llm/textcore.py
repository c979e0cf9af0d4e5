"""Vectorised word segmentation and hashing over Arrow string buffers.

Texts are never turned into Python strings here: words are found by a byte class
and hashed with a position-independent polynomial over the UTF-8 bytes, so the
cost is a few numpy passes a byte whatever the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SEGMENT = 1 << 20


def fold_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(non_word_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to a word; bytes of multi-byte characters always do."""
    t = np.ones(256, dtype=bool)
    for a, b in non_word_ranges:
        t[a : b + 1] = False
    return t


#: words are runs of anything but space and \t \n \v \f \r
NON_SPACE = [(0x20, 0x20), (0x09, 0x0D)]
#: words are runs of ASCII letters, digits and every non-ASCII character
ALNUM = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    if cache.get("n", 0) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        p, q = np.full(n, _U(_BASE)), np.full(n, _U(inverse))
        p[0] = q[0] = 1
        cache.update(n=n, p=np.cumprod(p, dtype=_U), q=np.cumprod(q, dtype=_U))
    return cache["p"], cache["q"]


def words(buf: np.ndarray, offs: np.ndarray, word: np.ndarray, fold: np.ndarray):
    """(hash, start byte, end byte) of every word, and each row's first word index (len rows + 1).

    Works through the bytes in segments that end between words, so extra memory is
    bounded for any text length (a single word longer than a segment extends it).
    """
    n, a = len(buf), 0
    hashes, starts, ends = [], [], []
    inner = offs[1:-1]
    while a < n:
        b = min(n, a + SEGMENT)
        while b < n:
            gap = np.flatnonzero(~word[buf[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
                break
            b = min(n, b + SEGMENT)
        seg = fold[buf[a:b]]
        m = word[seg]
        lo, hi = np.searchsorted(inner, [a, b])
        cut = inner[lo:hi] - a
        first = m.copy()
        first[1:] &= ~m[:-1]
        first[cut] = m[cut]
        last = m.copy()
        last[:-1] &= ~m[1:]
        back = cut[cut > 0] - 1
        last[back] = m[back]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            p, q = _powers(max(SEGMENT, len(seg)))
            total = np.zeros(len(seg) + 1, _U)
            np.cumsum((seg.astype(_U) + _U(1)) * p[: len(seg)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * q[s] + (e - s).astype(_U)))
            starts.append(s + a)
            ends.append(e + a)
        a = b
    if not hashes:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, _U), zero, zero, np.zeros(len(offs), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offs)


def ngrams(h: np.ndarray, k: int, skip: int = 0) -> np.ndarray:
    """Hashes of k consecutive words (with `skip` words left out before the last one)."""
    n = len(h) - k - skip + 1
    if n <= 0:
        return np.zeros(0, _U)
    acc = h[:n] + _U(k + 31 * skip)
    for j in range(1, k):
        acc = (acc ^ (acc >> _U(29))) * _U(0xD6E8FEB86659FD93) + h[j + (skip if j == k - 1 else 0) :][:n]
    return mix(acc)


def row_groups(buf_offs: np.ndarray, most_bytes: int = 4 << 20):
    """Row ranges of at most so many bytes (at least one row each)."""
    a, n = 0, len(buf_offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(buf_offs, buf_offs[a] + most_bytes, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
