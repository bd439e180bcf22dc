import zlib

import numpy as np
import pytest

from arbor.llm.feistel_shard import permute, place, row_of, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_is_a_permutation_with_inverse(n):
    x = np.arange(n)
    p = permute(x, n, 7)
    assert sorted(p) == list(range(n)) and (permute(p, n, 7, inverse=True) == x).all()
    shard, slot = place(x, n, 3, 7)
    assert (row_of(shard, slot, n, 3, 7) == x).all()
    assert n < 1000 or (permute(x, n, 8) != p).mean() > 0.9


def test_law_rows(spark):
    rows = [(i, f"text é {i % 5}", 0) for i in range(331)] + [(None, None, 1), (7, "same", 2), (7, "same", 3)] + [(9, "hot", 0)] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = shard_rows(df, buckets=13).collect()
    assert sorted((g.doc_id, g.size, g.text_crc32) for g in got if g.doc_id is not None) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows if i is not None)
    assert [(g.size, g.text_crc32) for g in got if g.doc_id is None] == [(1, 0)]
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g.slot)
    assert len(by) == 16 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shard_rows(df.repartition(7), buckets=13).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shard_rows(df.limit(0)).collect() == []


def test_copies_are_dealt_in_stretches(spark):
    df = spark.createDataFrame([(9, "hot")] * 150 + [(i, "x") for i in range(40)], "doc_id long, text string")
    a, b = (sorted((g.doc_id, g.row_no, g.shard, g.slot) for g in shard_rows(df, buckets=5, copies=n).collect()) for n in (1 << 16, 7))
    assert a == b and sorted(x[1] for x in a) == list(range(190))


def test_very_long_text(spark):
    got = shard_rows(spark.createDataFrame([(1, "é" * 2_000_000)], "doc_id long, text string")).collect()
    assert [(g.size, g.text_crc32, g.slot) for g in got] == [(4_000_001, zlib.crc32(("é" * 2_000_000).encode()), 0)]


def plain_permute(x, n, key):
    """The permutation in plain integers, one number at a time."""
    def mix(v):
        v = (v ^ (v >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        v = (v ^ (v >> 27)) * 0x94D049BB133111EB % 2**64
        return v ^ (v >> 31)

    h = 1
    while 4**h < n:
        h += 1
    keys = [mix((key + 0x9E3779B97F4A7C15 * (r + 1)) % 2**64) for r in range(6)]
    while True:
        left, right = x >> h, x % 2**h
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) % 2**h)
        x = left << h | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 4, 5, 17, 64, 65, 1000])
def test_permutation_equals_plain_integers(n):
    assert permute(np.arange(n), n, 2024).tolist() == [plain_permute(x, n, 2024) for x in range(n)]


def test_whole_query_equals_brute_force(spark):
    """Numbers by bucket and columns, then the permutation: every row's place, computed one row at a time."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    from arbor.llm.queries import QUERIES

    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    raw = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn("b", F.pmod(F.xxhash64(*cols), F.lit(1024)))
    order = sorted((r.b, r.doc_id, r.size, r.text_crc32) for r in rows.collect())
    n, want = len(order), []
    for i, (_, doc, size, crc) in enumerate(order):
        p = plain_permute(i, n, 2024)
        want.append((doc, size, crc, "rows", p % 16, p // 16, None, i))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(crc == zlib.crc32(texts[doc]) and size == len(texts[doc]) + 1 for doc, size, crc, *_ in want)
    got = [tuple(r) for r in QUERIES["op3_feistel_sharding"](spark, d).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_no").collect()]
    assert sorted(got) == sorted(want)
