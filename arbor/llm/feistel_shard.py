"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number; a keyed permutation of [0, n) moves it; shard = position mod shards and
slot = position div shards, so sizes differ by one row at most (law `rows`), slots have no gaps, and both
can be computed from the number alone, and the number from (shard, slot).

Row numbers. Rows are dealt to buckets of about BUCKET_ROWS rows (1024 buckets at least) by a hash of the id and digest,
numbered inside a bucket, and shifted by the rows of the buckets before. Equal rows are counted before they are numbered, so
a row that makes up a third of the table is one record until it is numbered; its copies are then dealt out in
stretches of COPIES. Neither the cluster nor the partitions of the input change a number.

Rules. A null text has size 1 and the CRC of no bytes; null ids are allowed; repeated rows each get a place
of their own; extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER_BUCKETS = 1024
BUCKET_ROWS = 1_000_000
COPIES = 1 << 16
ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of [0, n) under a key: Feistel on an even number of bits, walked until inside n."""
    h = _half_bits(n)
    half, mask = _U(h), _U((1 << h) - 1)
    rounds = [_mix(np.array([(key + 0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1)], np.uint64))[0] for r in range(ROUNDS)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):  # under a quarter of the domain is inside n at worst, so the rest shrinks geometrically
        v = out[todo]
        left, right = v >> half, v & mask
        for k in reversed(rounds) if inverse else rounds:
            if inverse:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        v = left << half | right
        out[todo] = v
        todo = todo[v >= _U(n)]
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(row, n, key)
    return p % shards, p // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: int) -> np.ndarray:
    """Global row numbers of places."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, inverse=True)


def number_rows(df: DataFrame, columns: list[str], buckets: int | None = None, copies: int = COPIES) -> tuple[DataFrame, int]:
    """Rows of the given columns with row_no in [0, n), and n."""
    buckets = buckets or max(NUMBER_BUCKETS, -(-df.count() // BUCKET_ROWS))
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sizes = {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()}  # `buckets` rows at most
    starts, at = {}, 0
    for b in sorted(sizes):
        starts[b] = at
        at += sizes[b]
    before = Window.partitionBy("bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.split(F.lit(",".join(str(starts.get(b, 0)) for b in range(buckets))), ",").cast("array<long>"), F.col("bucket") + 1)
    numbered = counted.withColumn("first", start + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    few = numbered.where(F.col("copies") <= copies).select(*columns, F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("row_no"))
    end = F.col("first") + F.col("copies") - 1
    many = numbered.where(F.col("copies") > copies).select(*columns, end.alias("end"), F.explode(F.sequence(F.col("first"), end, F.lit(copies).cast("bigint"))).alias("from"))
    many = many.repartition(F.col("from")).select(*columns, F.explode(F.sequence("from", F.least(F.col("from") + copies - 1, F.col("end")))).alias("row_no"))
    return few.unionByName(many), at


def shard_rows(docs: DataFrame, *, shards: int = 16, key: int = 2024, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, copies: int = COPIES) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard and slot."""
    raw = F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"], buckets, copies)

    @F.pandas_udf("shard int, slot long")
    def at(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), n, shards, key)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    return numbered.withColumn("p", at("row_no")).select("doc_id", "size", "text_crc32", "row_no", "p.shard", "p.slot")
