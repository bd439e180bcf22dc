"""Exact substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of `block` words; every rolling window of
`block` words of every document probes them. With window >= 2 * block - 1, each repeated window of
`window` words holds a reference block of its earliest place, so windows without a hit are unique and
never leave their cell. Hits are extended: the windows of `window` words around them are compared
corpus-wide, and runs of repeated windows are the maximal exact repeats.

Rules. A word is `[^\\x20\\x09-\\x0D]+`, unchanged. A window is repeated if its words also start earlier:
at a smaller id, or earlier in the same document. Null ids are one id below all others; rows with the
same id are ordered by the xxhash64 of their text, then by the text. Null and empty texts have no words; documents under `window` words
lose nothing; the input's other columns are ignored; an empty table gives an empty result. Comparison is
by 64-bit anchors and then independent 96-bit window hashes.

Scale. Three passes over the text, which is shuffled once by cell (the plan is one query, so Spark reuses
the exchange; without reuse it is only recomputed); the other shuffles carry about four
bytes a word and 14 bytes a repeated window. No group grows with the number of copies of a text.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm import cells as C
from arbor.llm.shared import release
from arbor.llm.textnum import bucket_of, utf8, windows, word_hashes

_U = np.uint64
_SENT = "bucket int, cell int, kind int, data binary"
_ANSWER = "cell int, bucket int, kind int, data binary"
ANCHOR, WINDOW = 0, 1


class _Cell:
    """The words and anchors of one cell, in a fixed order of its documents."""

    def __init__(self, table: pa.Table, n: int, block: int, window: int):
        self.n, self.window = n, window
        ids, keys = C.ids_of(table["doc_id"]), C.ids_of(table["key"])
        texts = table["text"].combine_chunks()
        order = np.lexsort((keys, ids))
        if len(np.unique(np.stack([ids, keys]), axis=1).T) < len(ids):
            words = texts.to_pylist()
            order = np.asarray(sorted(range(len(ids)), key=lambda i: (ids[i], keys[i], words[i] or "")), np.int64)
        self.ids, self.keys, self.texts = ids[order], keys[order], texts.take(pa.array(order))
        data, offsets = utf8(self.texts)
        self.h, self.first = word_hashes(data, offsets)
        a, ok = windows(self.h, self.first, block)
        self.start = np.flatnonzero(ok)
        self.anchor, self.where, self.times = np.unique(a, return_inverse=True, return_counts=True)
        self.bounds = bucket_of(self.anchor, n)
        self.own = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        at = self.start - self.first[self.own[self.start]]
        self.aligned = np.zeros(len(self.anchor), bool)
        self.aligned[self.where[at % block == 0]] = True

    def candidates(self, answers: pa.Table, block: int):
        """Windows around hits: distinct hashes, their check, first document, and for each window its entry."""
        hit = C.spread(C.unpack(answers, ANCHOR, self.n), self.bounds).astype(bool)
        flag = np.zeros(len(self.h) + 1, np.int32)
        if len(self.start):
            flag[self.start] = hit[self.where]
        seen = np.concatenate([[0], np.cumsum(flag)])
        w, ok = windows(self.h, self.first, self.window)
        check, _ = windows(self.h, self.first, self.window, seed=2)
        at = np.flatnonzero(ok)
        near = seen[at + self.window - block + 1] > seen[at]
        at, w, check = at[near], w[near], (check[near] & _U(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((at, check, w))
        at, w, check = at[order], w[order], check[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (check[1:] != check[:-1])
        return at, w, check, new


def _ask_anchors(n: int, block: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        release("substring_dedup")
        cell = table["cell"][0].as_py()
        c = _Cell(table, n, block, window)
        low, many = (c.anchor & _U(0xFFFFFFFF)).astype(np.uint32), c.times > 1
        rows = [(b, np.packbits(c.aligned[x:y]).tobytes() + np.packbits(many[x:y]).tobytes() + low[x:y].tobytes()) for b, (x, y) in enumerate(zip(c.bounds, c.bounds[1:])) if y > x]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "cell": pa.array([cell] * len(rows), pa.int32()), "kind": pa.array([ANCHOR] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    cells, data = table["cell"].to_pylist(), table["data"].to_pylist()
    low, aligned, many = [], [], []
    for d in data:
        # n entries take ceil(n / 8) bytes for each of two bit maps and 4 n bytes
        n = _entries(len(d))
        k = -(-n // 8)
        x = np.frombuffer(d, np.uint8)
        aligned.append(np.unpackbits(x[:k])[:n])
        many.append(np.unpackbits(x[k : 2 * k])[:n])
        low.append(np.frombuffer(d[2 * k :], np.uint32))
    sizes = [len(x) for x in low]
    _, where, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    times = times + np.bincount(where, np.concatenate(many), len(times))
    based = np.bincount(where, np.concatenate(aligned), len(times)) > 0
    hit = ((times > 1) & based)[where]
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    b = table["bucket"][0].as_py()
    return pa.table({"cell": pa.array(cells, pa.int32()), "bucket": pa.array([b] * len(cells), pa.int32()), "kind": pa.array([ANCHOR] * len(cells), pa.int32()), "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _entries(size: int) -> int:
    n = size * 4 // 17
    while 2 * -(-n // 8) + 4 * n < size:
        n += 1
    return n


def _ask_windows(n: int, block: int, window: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(table):
            cell = table["cell"][0].as_py()
            c = _Cell(table, n, block, window)
            at, w, check, new = c.candidates(answers, block)
            at, w, check = at[new], w[new], check[new]
            doc, bounds = c.own[at] if len(at) else at, bucket_of(w, n)
            for b, (x, y) in enumerate(zip(bounds, bounds[1:])):
                if y > x:
                    used, ref = np.unique(doc[x:y], return_inverse=True)
                    head = np.array([y - x, len(used)], np.int64)
                    rows.append((b, b"".join(z.tobytes() for z in (head, c.ids[used], c.keys[used], w[x:y], check[x:y], ref.astype(np.uint32 if len(used) > 65535 else np.uint16)))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "cell": pa.array([cell if rows else 0] * len(rows), pa.int32()), "kind": pa.array([WINDOW] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    cells, data = table["cell"].to_pylist(), table["data"].to_pylist()
    w, check, ids, keys, sizes = [], [], [], [], []
    for d in data:
        n, k = np.frombuffer(d[:16], np.int64).tolist()
        own = np.frombuffer(d, np.int64, 2 * k, 16)
        p = 16 + 16 * k
        w.append(np.frombuffer(d, np.uint64, n, p))
        check.append(np.frombuffer(d, np.uint32, n, p + 8 * n))
        at = np.frombuffer(d, np.uint32 if k > 65535 else np.uint16, n, p + 12 * n)
        ids.append(own[at])
        keys.append(own[k + at.astype(np.int64)])
        sizes.append(n)
    w, check, ids, keys = (np.concatenate(x) for x in (w, check, ids, keys))
    order = np.lexsort((keys, ids, check, w))
    again = np.zeros(len(w), bool)
    w, check = w[order], check[order]
    again[order[1:]] = (w[1:] == w[:-1]) & (check[1:] == check[:-1])
    parts = np.split(again, np.cumsum(sizes)[:-1])
    b = table["bucket"][0].as_py()
    return pa.table({"cell": pa.array(cells, pa.int32()), "bucket": pa.array([b] * len(cells), pa.int32()), "kind": pa.array([WINDOW] * len(cells), pa.int32()), "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


_OUT = "doc_id long, n_words long, n_removed long, text string, removed array<struct<start: int, end: int>>"


def _finish(n: int, block: int, window: int, digest: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        release("substring_dedup")
        if not len(table):
            c_ids, keep, texts, first = np.zeros(0, np.int64), np.zeros(0, bool), [], np.zeros(1, np.int64)
        else:
            c = _Cell(table, n, block, window)
            at, w, _, new = c.candidates(answers, block)
            again = ~new
            if len(w):
                again[new] |= C.spread(C.unpack(answers, WINDOW, n), bucket_of(w[new], n)).astype(bool)
            step = np.zeros(len(c.h) + 1, np.int32)
            np.add.at(step, at[again], 1)
            np.add.at(step, at[again] + window, -1)
            keep = np.cumsum(step)[: len(c.h)] == 0
            c_ids, texts, first = c.ids, c.texts.to_pylist(), c.first
        out, gone, removed = [], [], []
        for i, t in enumerate(texts):
            k = keep[first[i] : first[i + 1]]
            words = (t or "").encode().split()
            gone.append(len(k) - int(k.sum()))
            kept = b" ".join(words if not gone[-1] else compress(words, k.tolist()))
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            edge = np.flatnonzero(np.diff(np.concatenate([[True], k, [True]]).astype(np.int8))) if gone[-1] else []
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        ids = pa.array([None if x == C.NULL_ID else x for x in c_ids.tolist()], pa.int64())
        return pa.table({"doc_id": ids, "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "text": pa.array(out, pa.string()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10, digest: bool = False, cell_bytes: int = C.CELL_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, text and removed (half-open word ranges); digest: text is the SHA-256 of the kept text."""
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("a window must hold a whole block wherever it starts: block <= (window + 1) / 2")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    n = C.n_cells(docs, "text", cell_bytes)
    dealt = docs.withColumn("cell", C.cell_of(n, "doc_id", "key"))
    hits = dealt.groupBy("cell").applyInArrow(_ask_anchors(n, block, window), _SENT).groupBy("bucket").applyInArrow(_answer_anchors, _ANSWER)
    asked = dealt.groupBy("cell").cogroup(hits.groupBy("cell")).applyInArrow(_ask_windows(n, block, window), _SENT)
    repeats = asked.groupBy("bucket").applyInArrow(_answer_windows, _ANSWER)
    both = hits.unionByName(repeats)
    return dealt.groupBy("cell").cogroup(both.groupBy("cell")).applyInArrow(_finish(n, block, window, digest), _OUT)
