"""Cells and buckets: asking a question about every hash of a corpus without joining row by row.

Documents are dealt to cells by a hash of their id and text, so neither an id nor a text that many rows have
makes a large cell by itself. A cell sends its distinct hashes, once each and
sorted, to the buckets that own them; a bucket answers with one bit or byte per hash in the order it
got them, so an answer needs neither the hash nor a document. A hash that a third of all documents
hold is one entry per cell, and cells and buckets are even by construction.

There are as many buckets as cells, so messages grow with the square of the cells. Cells therefore grow with the
square root of the input once it is beyond CELL_BYTES ** 2 / MESSAGE_BYTES (24 GB): a message keeps MESSAGE_BYTES on average
and the number of messages grows with the input, not with its square. A task then holds 39 MB of text at 1 TB and
390 MB at 100 TB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one cell holds, which bounds the memory of a task.
CELL_BYTES = 6 << 20
#: Bytes of text for each message between a cell and a bucket, at least.
MESSAGE_BYTES = 1500
NULL_ID = np.iinfo(np.int64).min


def cells_for(size: int, cell_bytes: int = CELL_BYTES) -> int:
    """Cells for so many bytes of text."""
    return max(1, math.ceil(size / max(cell_bytes, math.sqrt(MESSAGE_BYTES * size))))


def n_cells(df: DataFrame, text: str, cell_bytes: int = CELL_BYTES) -> int:
    """Cells for a table, from the bytes of its texts."""
    return cells_for(df.agg(F.sum(F.octet_length(text).cast("long") + 16)).first()[0] or 0, cell_bytes)


def cell_of(n: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def ids_of(col) -> np.ndarray:
    """Ids as int64; null sorts before all others."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.int64)


def binaries(col) -> list[bytes]:
    return col.to_pylist()


def unpack(answers: pa.Table, kind: int, n: int, dtype=None) -> list[np.ndarray]:
    """The answers of one kind by bucket; dtype None: bits."""
    out = [np.zeros(0, np.uint8)] * n
    for k, b, data in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["data"].to_pylist()):
        if k == kind and data is not None:
            x = np.frombuffer(data, np.uint8)
            out[b] = np.unpackbits(x) if dtype is None else x
    return out


def spread(answers: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """Answers of all buckets in the order of the sorted hashes."""
    n = np.diff(bounds)
    return np.concatenate([a[:k] for a, k in zip(answers, n)]) if len(n) else np.zeros(0, np.uint8)
