"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of its words in WORDS hashed bins, of trigrams of character classes (runs of letters, digits and
blanks collapse) and a few repetition rates of its words and lines; square roots of shares times idf, reduced to DIMS dimensions
by the singular vectors of the labelled sample. The labelled vectors, at most SAMPLE_ROWS x DIMS numbers, go
to every executor. Each block of documents is multiplied with all of them, exactly; the K most similar vote
with weight similarity ** POWER, towards the share of label 1 in the sample when little is similar.

Training. Labelled rows of the learning fold, thinned by a hash of the id to about SAMPLE_ROWS (a
documented bound); idf, singular vectors and the vote use these rows only. Label, language, source and id are
never features.

Rules. Null and empty texts have the zero vector and score the sample's share of label 1. Unlabelled, null
and repeated label rows: rows without a label or id are dropped, the least label of an id counts. Without
any labelled row every score is 0.5. Whole texts are read; extra columns are dropped by `scores`. One pass,
no shuffle of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.shared import blocks, release
from arbor.llm.textnum import mix, utf8, windows, word_hashes

SAMPLE_ROWS = 2000
DIMS = 32
K = 25
POWER = 4
THRESHOLD = 0.7
PRIOR_WEIGHT = 0.05
BLOCK = 512

# Character classes by UTF-8 byte.
_N = 13
_CLASS = np.zeros(256, np.int64)  # letters without case and other bytes
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[46] = 5
_CLASS[44] = 6
_CLASS[ord("|")] = 7
_CLASS[[33, 63]] = 8
_CLASS[[ord(c) for c in "#$%&*"]] = 9
_CLASS[[ord(c) for c in "\"'()-:;"]] = 10
_CLASS[[ord(c) for c in "<>[]{}=+/\\_@^~`"]] = 11
_CLASS[0xC3] = 12
_COLLAPSE = np.isin(np.arange(_N), (0, 1, 2, 3, 4))
_RATES = 9
#: Bins of hashed words.
WORDS = 512
WIDTH = _N**3 + WORDS + _RATES


def features(col) -> np.ndarray:
    """One row of WIDTH numbers per text."""
    data, offsets = utf8(col)
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    cls = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1]) | ~_COLLAPSE[cls[1:]]
    c, r = cls[keep], row[keep]
    tri, ok = c[:-2] * _N * _N + c[1:-1] * _N + c[2:], r[:-2] == r[2:]
    np.add.at(out.reshape(-1), r[:-2][ok] * WIDTH + tri[ok], 1)
    h, first = word_hashes(data, offsets)
    m = np.maximum(np.diff(first), 1)
    own = np.repeat(np.arange(n), np.diff(first))
    np.add.at(out.reshape(-1), own * WIDTH + _N**3 + (h % np.uint64(WORDS)).astype(np.int64), 1)
    for lo, hi in ((0, _N**3), (_N**3, _N**3 + WORDS)):
        part = out[:, lo:hi]
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    np.sqrt(out, out)
    twice = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=n) / m
    pairs, ok2 = windows(h, first, 2)
    first2 = own[np.flatnonzero(ok2)]
    new = np.unique(mix(pairs + first2.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    unique = np.bincount(first2[new], minlength=n) / np.maximum(np.bincount(first2, minlength=n), 1)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda k: np.bincount(row[np.isin(cls, k)], minlength=n) / size
    lines = np.bincount(row[cls == 4], minlength=n) + 1
    rates = (twice, 1 - unique, share((1,)), share((7, 8, 9, 11)), share((2,)), share((5, 6)), np.minimum(lines / m, 1), np.minimum(size / m, 30) / 30, 1 / np.sqrt(m))
    for k, v in enumerate(rates):
        out[:, WIDTH - _RATES + k] = np.sqrt(np.maximum(v, 0))
    out[np.diff(first) == 0] = 0
    return out


class Model:
    """Weights, singular vectors, labelled vectors and labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = DIMS):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float64)
        if not len(y):
            return
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1.0
        self.idf[WIDTH - _RATES :] = 2.0
        used = np.flatnonzero(x.any(axis=0))
        w = (x[:, used] * self.idf[used]).astype(np.float64)
        if len(w) < len(used):  # the same vectors from the smaller product
            values, left = np.linalg.eigh(w @ w.T)
            vectors = (w.T @ left[:, ::-1][:, :dims]) / np.sqrt(np.maximum(values[::-1][:dims], 1e-9))
        else:
            vectors = np.linalg.eigh(w.T @ w)[1][:, ::-1][:, :dims]
        self.axes = np.zeros((x.shape[1], vectors.shape[1]))
        self.axes[used] = vectors
        self.points = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature rows, in blocks of exact cosine products with all labelled vectors."""
        if not len(self.y):
            return np.full(len(x), 0.5)
        out = np.full(len(x), self.prior)
        live = np.flatnonzero(x.any(axis=1))
        for at in range(0, len(live), BLOCK):
            rows = live[at : at + BLOCK]
            sims = self.project(x[rows]) @ self.points.T
            k = min(K, sims.shape[1])
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(sims, near, 1), 0, 1) ** POWER
            far = w.min(axis=1, keepdims=True) * 0.999  # neighbours no nearer than the farthest of the K count little
            w = w - far
            out[rows] = ((w * self.y[near]).sum(1) + PRIOR_WEIGHT * 1e-3 * self.prior) / (w.sum(1) + PRIOR_WEIGHT * 1e-3)
        return np.clip(out, 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of about sample_rows labelled rows of the learning fold."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    parts = 1 << 20
    share = max(1, min(parts, sample_rows * parts // max(1, marked.count())))
    some = F.broadcast(marked.where(F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(parts)) < share))  # about sample_rows rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(some, "__id").select("__id", "__text", F.col("__label").cast("int").alias("__label"))

    def run(batches):
        release("neighbour_quality")
        for b in batches:
            for s in blocks(b, "__text"):
                x = features(pa.chunked_array([s.column("__text")]))
                yield pa.record_batch([s.column("__id").cast(pa.int64()), s.column("__label"), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = sorted(rows.mapInArrow(run, "id long, y int, x binary").collect(), key=lambda r: (r.id, r.y, bytes(r.x)))
    x = np.zeros((len(got), WIDTH), np.float32)
    for row, r in zip(x, got):  # 16-bit places, then the values there
        n = len(r.x) // 6
        row[np.frombuffer(bytes(r.x[: 2 * n]), np.uint16)] = np.frombuffer(bytes(r.x[2 * n :]), np.float32)
    return Model(x, np.array([r.y for r in got]))


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE_ROWS x DIMS numbers and two matrices of WIDTH rows

    def run(batches):
        release("neighbour_quality")
        for b in batches:
            for s in blocks(b, "text"):
                yield pa.record_batch([s.column(0), s.column(1), pa.array(shared.value.scores(features(pa.chunked_array([s.column("text")]))))], ["doc_id", "held_out", "score"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that the model accepts, with all their columns; a model without labelled rows rejects none."""
    if not len(model.y):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release("neighbour_quality")
        for b in batches:
            for s in blocks(b, text_col):
                good = shared.value.scores(features(pa.chunked_array([s.column(text_col)]))) >= threshold
                yield s.filter(pa.array(good))
        release()

    return docs.mapInArrow(run, docs.schema)
