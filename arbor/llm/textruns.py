"""Runs of chosen bytes in many texts at once: where they are, their hashes and their strings.

Every kind of run ends at white space, and bytes of multi-byte characters are all inside or all outside, so runs of bytes are runs of
characters. A-Z are lower-cased, nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from arbor.llm import textnum as T

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Kind:
    """Runs of the bytes for which `member` holds."""

    def __init__(self, member: np.ndarray):
        self.member = member
        self.table = T._TABLE[:, LOWER].copy()
        self.table[:, ~member] = 0


def outside(spec: bytes) -> np.ndarray:
    """Which of the 256 bytes are not in spec."""
    out = np.ones(256, bool)
    out[list(spec)] = False
    return out


def runs(data: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every run, and for every text the number of its first run (one more entry than texts)."""
    starts, ends, hashes = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for a, b in T._segments(data, offsets):
        part = data[a:b]
        m = kind.member[part]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1] | edge[a + 1 : b]
        last[:-1] &= ~m[1:] | edge[a + 1 : b]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        pos = np.arange(len(part), dtype=np.int64) - at[np.maximum(np.cumsum(first) - 1, 0)]
        val = kind.table[pos & 63, part]
        if (far := pos > 63).any():
            val = np.where(far, val * (pos.astype(_U) >> _U(6) << _U(1) | _U(1)), val)
        hashes.append(T.mix(np.add.reduceat(val, at)))
        starts.append(at + a)
        ends.append(np.flatnonzero(last) + 1 + a)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets).astype(np.int64)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased runs as strings, copied in one step."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    raw = LOWER[data[np.repeat(start - at[:-1], n) + np.arange(at[-1])]] if at[-1] else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at), pa.py_buffer(raw))
