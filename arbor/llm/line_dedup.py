"""Line dedup: line hashes in ranges, sorted by document and position, first occurrences streamed, bitmaps returned.

1. Every text is cut at \\n; a line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Keys of
   at least `min_chars` code points become rows (128-bit hash, document, text, position). No text moves.
2. The rows are partitioned by ranges of (hash, document, position) and sorted so inside the partitions. Documents and positions are
   part of the range, so a line of a third of all documents is spread over as many partitions as its rows fill.
3. A task streams its rows: the first document of a run of one hash owns the line, later ones lose it once `min_docs` documents
   are seen. Runs that go on in other partitions are told by a first pass over the sorted rows, which returns the first and
   last run of each partition: two rows a partition reach the driver, whatever the number of documents.
4. Lost positions become one compressed bitmap a document; `apply_bitmaps` cuts texts by them.

Rules. A document is an id: rows with one id are one document when documents are counted and owners chosen, each with its own bitmap.
Null ids are one id, below all others. A null or empty text is one empty line. The owner is the largest id (`keep="last"`) or the smallest
(`keep="first"`), and keeps all its lines of that key, repeats included. Repeated rows (id and text) have one
bitmap. Texts are told by their MD5. Lines may be of any length and number; other columns are ignored; an empty table gives an
empty result. Sorted rows are cut from their lineage by checkpoint().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.shared import ensure_checkpoint_dir, release

_BLANK = b" \t\n\x0b\x0c\r"
_LINE = "h1 long, h2 long, doc_id long, row_key binary, pos int"
_EDGE = "part int, h1 long, h2 long, first long, last long, docs long, whole boolean"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("row_key"), text.alias("text"))


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pos, hashes = [], [], []
            for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                for p, line in enumerate(t.split(b"\n")):
                    key = line.strip(_BLANK).lower()
                    n = len(key)
                    if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars):
                        rows.append(i)
                        pos.append(p)
                        hashes.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column("doc_id").take(at), b.column("row_key").take(at), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "row_key", "pos"])
        release("line_dedup")

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition: key, first and last document, number of documents."""
    done, run, part = [], None, 0
    for b in batches:
        if len(b):
            part = b.column("part")[0].as_py()
        for h1, h2, d in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("doc_id").to_pylist()):
            if run is None or run[0] != h1 or run[1] != h2:
                if run is not None and not done:
                    done.append(run)
                run = [h1, h2, d, d, 1]
            elif run[3] != d:
                run[3], run[4] = d, run[4] + 1
    if run is None:
        return
    rows = [(part, *r, not done) for r in [*done, run]]
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.bool_())
    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _names(_EDGE))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joints(edges: list) -> tuple[dict, dict]:
    """From the edge runs of all partitions: what came before the first run of each (owner, documents, last document), and how many documents follow its last."""
    parts: dict[int, list] = {}
    for e in edges:
        parts.setdefault(e.part, []).append(e)
    head, tail, state = {}, {}, None
    for p in sorted(parts):
        first, last = parts[p][0], parts[p][-1]
        if state is not None and state[0] == (first.h1, first.h2):
            head[p] = state[1:]
            if first.whole:
                state = (state[0], state[1], state[2] + first.docs - (state[3] == first.first), first.last)
        if p not in head or not first.whole:
            state = ((last.h1, last.h2), last.first, last.docs, last.last)
    state = None
    for p in sorted(parts, reverse=True):
        first, last = parts[p][0], parts[p][-1]
        if state is not None and state[0] == (last.h1, last.h2):
            tail[p] = state[1] - (state[2] == last.last)
        state = ((first.h1, first.h2), first.docs + (tail.get(p, 0) if first.whole else 0), first.first)
    return head, tail


def _losers(head: dict, tail: dict, min_docs: int):
    """Streams sorted rows; yields those that lose their line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner, last, seen, waiting, fresh, part = None, None, None, 0, [], True, 0
        for b in batches:
            if not len(b):
                continue
            lost = []
            if fresh:
                part = b.column("part")[0].as_py()
            docs, texts, places = (b.column(c).to_pylist() for c in ("doc_id", "row_key", "pos"))
            for i, k in enumerate(zip(b.column("h1").to_pylist(), b.column("h2").to_pylist())):
                d = docs[i]
                if k != key:
                    key, waiting = k, []
                    owner, seen, last = head[part] if fresh and part in head else (d, 1, d)
                fresh = False
                if d != last:
                    last, seen = d, seen + 1
                if d != owner:
                    if seen >= min_docs:
                        if waiting:
                            lost += waiting
                            waiting = []
                        lost.append((d, texts[i], places[i]))
                    else:
                        waiting.append((d, texts[i], places[i]))
            if lost:
                yield _lost(lost)
        if waiting and seen + tail.get(part, 0) >= min_docs:
            yield _lost(waiting)

    return run


def _lost(rows: list) -> pa.RecordBatch:
    d, k, p = zip(*rows)
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(k, pa.binary()), pa.array(p, pa.int32())], ["doc_id", "row_key", "pos"])


def unpack_bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    """Which lines stay; an empty bitmap keeps all."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool) if keep else np.ones(n_lines, bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist()):
            if gone:
                bits = np.ones(n, bool)
                bits[gone] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            else:
                keep.append(b"")
        yield pa.record_batch([b.column("doc_id"), b.column("row_key"), b.column("n_lines"), b.column("n_dropped"), pa.array(keep, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: str = "last", partitions: int | None = None) -> DataFrame:
    """doc_id, row_key (MD5 of the text), n_lines, n_dropped and keep (zlib of one bit a line, empty if all stay), one row for each id and text."""
    if keep not in ("last", "first"):
        raise ValueError("keep is last or first")
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    lines = keyed.mapInArrow(_hash_lines(min_chars), _LINE)
    order = [F.col("h1"), F.col("h2"), F.desc("doc_id") if keep == "last" else F.asc("doc_id"), F.col("pos")]
    ranged = lines.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    placed = ranged.checkpoint().withColumn("part", F.spark_partition_id())
    edges = placed.select("part", "h1", "h2", "doc_id").mapInArrow(_edges, _EDGE).collect()  # at most two rows a partition
    lost = placed.mapInArrow(_losers(*_joints(edges), min_docs), "doc_id long, row_key binary, pos int")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    every = keyed.select("doc_id", "row_key", n_lines.alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    both = every.unionByName(lost.withColumn("n_lines", F.lit(None).cast("long"))).groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    counted = both.withColumn("n_dropped", F.size("gone").cast("long"))
    return counted.mapInArrow(_pack, "doc_id long, row_key binary, n_lines long, n_dropped long, keep binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for t, keep, n in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), b.column("n_lines").to_pylist()):
            texts.append("\n".join(x for x, k in zip(t.split("\n"), unpack_bitmap(keep, n)) if k) if keep else t)
        yield pa.record_batch([b.column("doc_id"), b.column("n_lines"), b.column("n_dropped"), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])
    release("line_dedup")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, one row for every row of docs."""
    keyed, b = _keyed(docs, id_col, text_col), bitmaps.withColumnRenamed("doc_id", "__id").withColumnRenamed("row_key", "__key")
    same = keyed["row_key"].eqNullSafe(b["__key"]) & keyed["doc_id"].eqNullSafe(b["__id"])
    return keyed.join(b, same).select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_cut, "doc_id long, n_lines long, n_dropped long, text string")
