"""Ranked lexical search over dual-sorted wavelet trees, one a shard, with exact top-k by best-first intersection.

1. Index. A shard is what one task reads, up to `shard_bytes` of text, so no text is shuffled. Its documents are numbered by id. For every
   term its postings are ordered by falling impact; the document numbers of all postings, in this order, are one sequence, stored as a wavelet
   tree (bits by level, from the highest bit of the number). A node of the tree is a range of document numbers;
   inside it the postings of a term keep their order, so the first of them has the highest impact of the term in that range.
2. Search. For one item the intervals of its terms go down the tree together. The bound of a node is the sum over its terms of weight times
   the impact of the first posting, and is the score at a leaf. Nodes with the highest bounds are opened first, some at a time, until none can
   come before the k-th document found. A task keeps its k best from shard to shard, and starts with them.
3. The k best of each task meet in a window, k rows an item and task.

Scores. Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. N counts the documents with a term, L their terms, n
those of one document, df the documents of a term: weight floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + (75 n N) div L,
impact (10^9 tf) div (1000 tf + 8 m). An item's repeated terms count as often. Terms are told by 64-bit hashes.

Rules. Null and empty texts have no term and are never found; so are documents whose terms are in all documents (weight 0). Ids may be null, which is
below all others, and repeat: each row is a document. Equal scores are ordered by id. Items without a known term have no rows; rows of
items with one id are one item with the terms of all. Texts may be of any length: a text above shard_bytes is a shard of its own. Other columns are
ignored; empty tables give an empty result. Items are asked in blocks of `block_terms` terms, so what goes to every task is bounded.

The index is a table in the folder given, or in the shared checkpoint folder, and can be asked again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.llm import cells as C
from arbor.llm.shared import release, stage_folder
from arbor.llm.textnum import utf8
from arbor.llm.textruns import Kind, outside, runs

SHARD_BYTES = 8 << 20
#: Terms of items, with their repeats counted once, that go to every task at a time (20 bytes each).
BLOCK_TERMS = 1_000_000
#: Intervals that are opened at once.
STEP = 2048
_TERMS = Kind(outside(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
_SHARD = "shard string, n_docs long, doc_ids binary, terms binary, starts binary, impacts binary, bits binary"


def _hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all rows and where each row's begin."""
    _, _, h, first = runs(*utf8(col), _TERMS)
    return h, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.diff(_hashes(b.column("text"))[1])
        yield pa.record_batch([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L."""
    r = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Impacts of postings with these counts in documents of n terms."""
    if 75 * int(n.max(initial=0)) * docs < 1 << 63:
        m = 25 + 75 * n * docs // terms
    else:
        m = np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about so many bytes of text, at least one row each."""
    held, have = [], 0
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(b):
            room = np.searchsorted(np.cumsum(n[at:]), size - have, side="right")
            end = at + int(room)
            if end == at and not held:
                end = at + 1
            if end > at:
                held.append(b.slice(at, end - at))
                have += int(n[at:end].sum())
                at = end
            if at < len(b):
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _build(docs: int, terms: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("wavelet_search")
        for t in _pieces(batches, size):
            ids = C.ids_of(t["doc_id"])
            order = np.argsort(ids, kind="stable")
            t = t.take(pa.array(order))
            h, first = _hashes(t["text"])
            n = np.diff(first)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            number = np.zeros(len(n), np.int64)
            number[some] = np.arange(len(some))
            have, term = np.unique(h, return_inverse=True)
            post, tf = np.unique(term.astype(np.int64) * len(some) + number[np.repeat(np.arange(len(n)), n)], return_counts=True)
            term, doc = np.divmod(post, len(some))
            imp = impacts(tf, n[some][doc], docs, terms)
            order = np.lexsort((doc, -imp, term))
            doc, imp = doc[order].astype(np.int32), imp[order].astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(have)))]).astype(np.int32)
            bits, seq = [], doc
            for k in reversed(range(_levels(len(some)))):
                one = (seq >> k & 1).astype(bool)
                bits.append(np.packbits(one).tobytes())
                seq = np.concatenate([seq[~one], seq[one]])
            row = (uuid.uuid4().hex, len(some), ids[np.argsort(ids, kind="stable")][some].tobytes(), have.tobytes(), starts.tobytes(), imp.tobytes(), b"".join(bits))
            kinds = (pa.string(), pa.int64(), *[pa.binary()] * 5)
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _SHARD.split(", ")])

    return run


def _levels(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


class Shard:
    """A shard's tree: at every level the ones before each place and the impacts in that level's order."""

    def __init__(self, n_docs: int, doc_ids: bytes, terms: bytes, starts: bytes, impact: bytes, bits: bytes):
        self.ids, self.terms, self.starts = np.frombuffer(doc_ids, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32).astype(np.int64)
        x, n = np.frombuffer(impact, np.int32), len(impact) // 4
        self.depth = _levels(n_docs)
        raw = np.frombuffer(bits, np.uint8).reshape(self.depth, -1)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.impact = np.zeros((self.depth + 1, n), np.int32)
        self.impact[0] = x
        for k in range(self.depth):
            one = np.unpackbits(raw[k], count=n).astype(bool)
            np.cumsum(one, out=self.ones[k, 1:])
            x = np.concatenate([x[~one], x[one]])
            self.impact[k + 1] = x
        self.zeros = n - self.ones[:, -1].astype(np.int64)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]], step: int = STEP) -> list[tuple[int, int]]:
        """The k best (-score, id) of this shard and of `best`."""
        at = np.searchsorted(self.terms, terms)
        known = (at < len(self.terms)) & (weights > 0)
        known[known] = self.terms[at[known]] == terms[known]
        at, w = at[known], weights[known]
        if not len(at):
            return best
        width = max(1, step // len(at))
        lo, hi = self.starts[at][None, :], self.starts[at + 1][None, :]
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([(self.impact[0, lo[0]].astype(np.int64) * w).sum()])
        floor = best[k - 1] if len(best) == k else None
        while len(bound):
            if floor is not None:
                live = (bound > -floor[0]) | ((bound == -floor[0]) & (self.ids[first] < floor[1]))
                if not live.all():
                    level, first, bound, lo, hi = level[live], first[live], bound[live], lo[live], hi[live]
                    if not len(bound):
                        break
            n = min(width, len(bound))
            pick = np.argpartition(-bound, n - 1)[:n] if n < len(bound) else np.arange(n)
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            lv, l, h, f = level[pick], lo[pick], hi[pick], first[pick]
            a, b = self.ones[lv[:, None], l].astype(np.int64), self.ones[lv[:, None], h].astype(np.int64)
            z = self.zeros[lv][:, None]
            cl, ch = np.concatenate([l - a, z + a]), np.concatenate([h - b, z + b])
            cv = np.concatenate([lv, lv]) + 1
            cf = np.concatenate([f, f + (1 << (self.depth - 1 - lv))])
            has = ch > cl
            value = np.where(has, self.impact[cv[:, None], np.minimum(cl, self.impact.shape[1] - 1)], 0).astype(np.int64) @ w
            there = value > 0
            leaf = there & (cv == self.depth)
            if leaf.any():
                s, d = value[leaf], self.ids[cf[leaf]]
                if floor is not None:
                    fine = (s > -floor[0]) | ((s == -floor[0]) & (d < floor[1]))
                    s, d = s[fine], d[fine]
                best = sorted([*best, *zip((-s).tolist(), d.tolist())])[:k]
                floor = best[k - 1] if len(best) == k else None
            go = there & (cv < self.depth)
            level, first, bound = (np.concatenate([x[rest], y[go]]) for x, y in ((level, cv), (first, cf), (bound, value)))
            lo, hi = np.concatenate([lo[rest], cl[go]]), np.concatenate([hi[rest], ch[go]])
        return best


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> DataFrame:
    """Writes one row a shard to the folder and reads it again; `docs` and `terms` of the whole corpus are columns of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, length = totals(docs)
    path = folder or f"{stage_folder(spark)}/wavelet_index"
    built = docs.mapInArrow(_build(n, max(length, 1), shard_bytes), _SHARD)
    built.withColumns({"corpus_docs": F.lit(n).cast("long"), "corpus_terms": F.lit(length).cast("long")}).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _dfs(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for b in batches:
            for have, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist()):
                have, n = np.frombuffer(have, np.uint64), np.diff(np.frombuffer(starts, np.int32))
                at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                df += np.where(have[at] == wanted, n[at], 0)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


def _search(asked: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("wavelet_search")
        best: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                s = Shard(*(r[c] for c in ("n_docs", "doc_ids", "terms", "starts", "impacts", "bits")))
                for i, terms, weights in asked:
                    best[i] = s.top(terms, weights, k, best.get(i, []))
        rows = [(i, None if d == C.NULL_ID else d, -s) for i, got in best.items() for s, d in got]
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item_id", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, first = _hashes(b.column("text"))
        items = b.column("item_id").take(pa.array(np.repeat(np.arange(len(b)), np.diff(first))))
        yield pa.record_batch([items, pa.array(h.view(np.int64))], ["item_id", "term"])


def _block(index: DataFrame, terms: list, k: int, n: int) -> DataFrame:
    """The search for the items of one block: rows (item_id, term, times)."""
    wanted = np.unique(np.array([r.term for r in terms], np.int64).view(np.uint64))
    df = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "starts").mapInArrow(_dfs(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one row a term of the block
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    items: dict = {}
    for r in terms:
        items.setdefault(r.item_id, []).append((r.term, r.times))
    asked = []
    for i, t in items.items():
        h = np.array([x[0] for x in t], np.int64).view(np.uint64)
        asked.append((i, h, weight[np.searchsorted(wanted, h)] * np.array([x[1] for x in t], np.int64)))
    return index.select("n_docs", "doc_ids", "terms", "starts", "impacts", "bits").mapInArrow(_search(asked, k), "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item."""
    spark: SparkSession = items.sparkSession
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_item_terms, "item_id long, term long")
    asked = asked.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    n = index.select("corpus_docs").first()
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    held: list = []
    # items come one after the other; a block is at most block_terms terms, or one item
    for r in asked.orderBy("item_id").toLocalIterator() if n and n[0] else ():
        if len(held) >= block_terms and r.item_id != held[-1].item_id:
            found, held = found.unionByName(_block(index, held, k, n[0])), []
        held.append(r)
    if held:
        found = found.unionByName(_block(index, held, k, n[0]))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
