"""Vectorised text kernels shared by the corpus operators.

Everything here works on Arrow string buffers: the UTF-8 bytes of many documents in one NumPy array plus their
offsets, so that splitting into words and hashing windows cost a few passes over bytes and no Python loop per word.
A null text has no bytes. Words never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once, few enough for its arrays to stay in a core's cache; a longer document is
#: a block of its own.
BLOCK_BYTES = 128 << 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LUT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
_ALNUM_ANY = _ALNUM.copy()
_ALNUM_ANY[65:91] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, 2 * BLOCK_BYTES)
        have = np.empty(m, np.uint64)
        have[0] = 1
        k = 1
        while k < m:
            step = _U(pow(base, k, 1 << 64))
            have[k : 2 * k] = have[: min(k, m - k)] * step
            k *= 2
        if m <= 16 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_bounds(raw: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of its first word (n+1 numbers).

    kind: "space" for runs of bytes other than space and \\t..\\r, "alnum" for digits, letters and bytes above ASCII.
    """
    is_word = (_NOT_SPACE if kind == "space" else _ALNUM_ANY)[raw]
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    first, last = np.empty(n, bool), np.empty(n, bool)
    np.logical_not(is_word[:-1], out=first[1:])
    np.logical_not(is_word[1:], out=last[:-1])
    first[0] = last[-1] = True
    inner = off[(off > 0) & (off < n)]
    first[inner] = True
    last[inner - 1] = True
    first &= is_word
    last &= is_word
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; those after the end are 0."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a time go through a mixer, so that no two spans are equal
    by an identity of polynomials; spans of up to eight bytes never share a hash with another of their length."""
    at_place = _eights(_LOWER[raw] if lower else raw)
    n = ends - starts
    h = mix(mix(at_place[starts] & _FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    more, k = np.flatnonzero(n > 8), 8
    while len(more):
        x = at_place[starts[more] + k] & _FIRST[np.minimum(n[more] - k, 8)]
        h[more] = mix(mix(h[more] + _U(0x9FB21C651E98DF25)) ^ mix(x + _U(k)) * _U(0xC2B2AE3D27D4EB4F))
        k += 8
        more = more[n[more] > k]
    return h


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each span of raw, whether its bytes are those of the span of other beside it."""
    x, y, n = _eights(raw), _eights(other), ends - starts
    out = n == to - from_
    left, k = np.flatnonzero(out), 0
    while len(left):
        mask = _FIRST[np.minimum(n[left] - k, 8)]
        equal = (x[starts[left] + k] & mask) == (y[from_[left] + k] & mask)
        out[left[~equal]] = False
        k += 8
        left = left[equal & (n[left] > k)]
    return out


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, with `gap` spaces after each, and where each begins."""
    size = ends - starts
    to = np.cumsum(size + gap) - size - gap
    out = np.full(int((size + gap).sum()), 32, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = raw[np.repeat(starts, size) + step]
    return out, to


def lowered(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z as a-z."""
    return _LOWER[raw]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; windows that cross documents are for the caller to leave out."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    if k <= 8:
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h *= _U(0xC2B2AE3D27D4EB4F)
            h += words[j : n - k + 1 + j]
        return mix(h)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_BASE_INV, n)[: n - k + 1])


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive bytes."""
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    values = _LUT[raw]
    values *= powers(_BASE, n)
    np.cumsum(values, out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_BASE_INV, n)[: n - k + 1])
