"""Hashes of words straight from Arrow buffers, many documents at a time, in numpy.

A word's hash is a polynomial over its bytes modulo 2^64 followed by a finaliser, so equal words have equal hashes on
every executor. All functions work on one Arrow batch; bytes are taken in pieces of about PIECE so that the
temporaries stay small whatever the texts' lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_POW = np.empty(PIECE + 1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if getattr(_powers, "done", 0) < n:
        with np.errstate(over="ignore"):
            p = np.full(n, _B, np.uint64)
            p[0] = 1
            _POW = np.cumprod(p, dtype=np.uint64)
        _powers.done = n
    return _POW


def byte_tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word; its random value after A-Z become a-z."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    value = _BYTE.copy()
    value[65:91] = _BYTE[97:123]
    return word, value


#: Words of anything but white space.
SPACED = byte_tables(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters, digits and all that isn't ASCII.
ALNUM = byte_tables(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array, tables=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and first[i]:first[i+1], row i's part of them."""
    is_word, value = tables
    data, offsets = text_buffers(column)
    hashes, ends = [], []
    lo, hi = int(offsets[0]), int(offsets[-1])
    cuts = np.zeros(0, np.int64)
    while lo < hi:
        to = min(hi, lo + PIECE)
        if to < hi:  # a piece ends behind a separator or at a row's end
            tail = np.flatnonzero(~is_word[data[lo:to]])
            row_end = offsets[np.searchsorted(offsets, to, "right") - 1]
            back = lo + int(tail[-1]) + 1 if len(tail) else lo
            to = max(back, int(row_end)) if max(back, int(row_end)) > lo else _next_cut(data, is_word, offsets, to, hi)
        piece = data[lo:to]
        flag = is_word[piece]
        inner = offsets[(offsets > lo) & (offsets < to)] - lo
        begins = flag.copy()
        begins[1:] &= ~flag[:-1]
        if len(inner):
            begins[inner] |= flag[inner]
        s = np.flatnonzero(begins)
        stops = flag.copy()
        stops[:-1] &= ~flag[1:]
        if len(inner):
            stops[inner - 1] |= flag[inner - 1]
        e = np.flatnonzero(stops) + 1
        if len(s):
            hashes.append(_hash(piece, value, s, e))
            ends.append(s + lo)
        lo = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    cuts = np.concatenate(ends)
    return np.concatenate(hashes), np.searchsorted(cuts, offsets, "left")


def _next_cut(data, is_word, offsets, to, hi) -> int:
    """The first separator or row end after to: a word longer than a piece is taken whole."""
    row_end = int(offsets[np.searchsorted(offsets, to, "left")])
    while to < row_end:
        sep = np.flatnonzero(~is_word[data[to : min(row_end, to + PIECE)]])
        if len(sep):
            return to + int(sep[0]) + 1
        to = min(row_end, to + PIECE)
    return min(row_end, hi)


def _hash(piece, value, s, e) -> np.ndarray:
    """Each word's bytes are weighted by powers from the word's own first byte on."""
    with np.errstate(over="ignore"):
        n = e - s
        p = _powers(max(PIECE, int(n.max())) + 1)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        terms = value[piece[np.repeat(s, n) + at]] * p[at]
        sums = np.add.reduceat(terms, np.cumsum(n) - n)
        return mix(sums + n.astype(np.uint64) * _U(0xA24BAED4963EE407))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words at each position (k - 1 fewer than words), over row borders too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * _U(0xC2B2AE3D27D4EB4F) + h[i : len(h) - k + 1 + i]
            out = out ^ (out >> _U(29))
        return mix(out + _U(k))
