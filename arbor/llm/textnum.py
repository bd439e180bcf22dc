"""Numpy helpers that run inside tasks: words and word-window hashes of many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts come as UTF-8; no byte of a
multi-byte character is white space, so byte-wise splitting is character-wise splitting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 2**64 - 1, size=(64, 256), dtype=np.uint64, endpoint=True)
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_TABLE[:, _WS] = 0
_LOW = np.arange(256)
_LOW[65:91] += 32
_TABLE_LOWER = _TABLE[:, _LOW]
_COEF = {seed: np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, size=64, dtype=np.uint64) * _U(2) + _U(1) for seed in (1, 2)}
SEGMENT = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about SEGMENT bytes that end between texts or at white space."""
    a, total = 0, len(data)
    while a < total:
        b = min(a + SEGMENT, total)
        if b < total:
            k = offsets[np.searchsorted(offsets, b, side="right") - 1]
            if k > a:
                b = int(k)
            else:
                end = int(offsets[np.searchsorted(offsets, b, side="right")])
                while b < end and not _WS[data[b]]:
                    b += 1
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for every text the position of its first word (one more entry than texts)."""
    table = _TABLE_LOWER if lower else _TABLE
    hashes, starts_at = [], []
    is_start = np.zeros(len(data) + 1, bool)
    is_start[offsets] = True
    for a, b in _segments(data, offsets):
        part = data[a:b]
        ws = _WS[part]
        first = ~ws
        first[1:] &= ws[:-1] | is_start[a + 1 : b]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        pos = np.arange(len(part), dtype=np.int64) - at[np.maximum(np.cumsum(first) - 1, 0)]
        val = table[pos & 63, part]
        if (far := pos > 63).any():
            val = np.where(far, val * (pos.astype(np.uint64) >> _U(6) << _U(1) | _U(1)), val)
        hashes.append(mix(np.add.reduceat(val, at)))
        starts_at.append(at + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets).astype(np.int64)


def windows(h: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one text, by their first word, and which words begin one."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(n, bool)
    coef = _COEF[seed]
    acc = h[: n - k + 1] * coef[0]
    for j in range(1, k):
        acc += h[j : n - k + 1 + j] * coef[j]
    ends = np.repeat(first[1:], np.diff(first))  # end of the text each word is in
    ok = np.arange(n) + k <= ends
    return mix(acc[ok[: n - k + 1]]), ok


def bucket_of(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal ranges of the hash space in a sorted array."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64) if n > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)
