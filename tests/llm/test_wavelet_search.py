import math
import random
import re
from collections import Counter

import pytest

from arbor.llm.wavelet_search import build_index, impacts, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n, length = len(tf), sum(x[2] for x in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        got = []
        for d, c, m in tf:
            m = 25 + 75 * m * n // length
            s = sum(q[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                got.append((-s, d is not None, d, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, block=1000, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, shard string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(build_index(df, **kw), q, k, block_terms=block).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "w" + str(int(r.paretovariate(0.7)) % 300)
    docs = [(d, r.choice(" .,-\n").join(word() for _ in range(r.choice([0, 1, 5, 40, 200])))) for d in range(150)]
    docs += [(200 + i, docs[9][1]) for i in range(30)] + [(None, docs[9][1]), (None, None), (300, ""), (301, "Ünïcode W1 w1 W_1"), (5, docs[11][1]), (5, docs[9][1])]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 12, 60])))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown words only"), (53, docs[9][1]), (54, "ünïcode _w1"), (3, "w4 w4 w4")]
    r.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed,k,size,block", [(1, 10, 700, 1000), (2, 3, 1 << 20, 20), (3, 10, 1, 1)])
def test_equals_brute_force(spark, seed, k, size, block):
    """Shards of a few documents, one shard a task, and one document a shard; items in one block and in many."""
    docs, items = corpus(seed)
    assert run(spark, docs, items, k, block, shard_bytes=size) == brute(docs, items, k)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None), (2, "..")], [(1, "a")]) == []


def test_term_of_all_documents_has_no_weight_above_its_floor(spark):
    docs = [(i, "same") for i in range(2000)]
    assert run(spark, docs, [(1, "same")]) == brute(docs, [(1, "same")], 10) == []


def test_very_long_texts_and_many_copies(spark):
    docs = [(1, "word " * 300_000 + "rare"), (2, " ".join(f"t{i}" for i in range(60_000)))] + [(10 + i, "a copy of one text") for i in range(500)]
    items = [(1, "rare word t7"), (2, "copy text"), (3, " ".join(f"t{i}" for i in range(20_000)))]
    assert run(spark, docs, items, shard_bytes=2000) == brute(docs, items, 10)


def test_impacts_beyond_64_bits():
    import numpy as np

    n, docs, length = np.array([10**9, 5]), 10**12, 10**15
    want = [10**9 * 3 // (3000 + 8 * (25 + 75 * x * docs // length)) for x in (10**9, 5)]
    assert impacts(np.array([3, 3]), n, docs, length).tolist() == want


def test_index_is_a_table_that_can_be_asked_again(spark, tmp_path):
    docs, items = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    build_index(df, folder=f"{tmp_path}/index")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = search(spark.read.parquet(f"{tmp_path}/index"), q, 4).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, 4)
