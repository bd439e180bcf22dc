import math
import random
import re

import pytest

from arbor.operators import inverted_index as I
from arbor.operators import retrieval as V
from arbor.session import ensure_checkpoint_dir


def brute(texts, queries, k, k1=1.5, b=0.75):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    tok = [(d, words(t)) for d, t in texts]
    n, avg = len(tok), sum(len(t) for _, t in tok) / len(tok)
    df = {}
    for _, t in tok:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, text in queries:
        got = []
        for d, t in tok:
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * (k1 + 1) / (t.count(x) + k1 * (1 - b + b * len(t) / avg)) for x in set(words(text)) if x in t)
            if s:
                got.append((-round(s, 9), d))
        out += [(q, d, round(-s, 6), r) for r, (s, d) in enumerate(sorted(got)[:k], 1)]
    return sorted(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    word = lambda: "w" + str(int(r.paretovariate(0.6)) % 500)
    texts = [(i, " ".join(word() for _ in range(r.choice([0, 1, 8, 30])))) for i in range(n)]
    texts += [(n + i, texts[7][1] + " tie") for i in range(60)] + [(n + 70, None), (n + 71, "Ünder_score ÜNDER w1")]
    return texts, [(i, " ".join(word() for _ in range(r.choice([1, 4, 25])))) for i in range(15)] + [(20, None), (21, "unknown"), (22, "ünder tie w1")]


@pytest.mark.parametrize("seed,k,block,terms", [(1, 5, 20, 500_000), (2, 10, 2048, 500_000), (3, 3, 7, 10)])
def test_equals_scoring_everything(spark, tmp_path, seed, k, block, terms):
    ensure_checkpoint_dir(spark)
    texts, queries = corpus(seed)
    folder = str(tmp_path / "bm25")
    df, q = spark.createDataFrame(texts, "doc_key long, text string"), spark.createDataFrame(queries, "query_id long, query_text string")
    I.build_index(df, folder, block_texts=block)
    got = sorted((r.query_id, r.doc_key, round(r.score, 6), r["rank"]) for r in I.top_k(folder, q, k, query_terms=terms).collect())
    assert got == brute(texts, queries, k)
    old = sorted((r.query_id, r.doc_key, round(r.score, 6), r["rank"]) for r in V.bm25(df, q, k).collect())
    assert got == old


def test_few_texts_are_scored(spark, tmp_path):
    """Texts that hold only frequent words of a query are not scored once rarer ones have filled the k best."""
    ensure_checkpoint_dir(spark)
    r = random.Random(5)
    texts = [(f"{i:05d}", "the of and " + " ".join(f"x{r.randrange(40)}" for _ in range(10))) for i in range(3000)]
    folder = str(tmp_path / "bm25")
    df = spark.createDataFrame(texts, "doc_key string, text string")
    I.build_index(df, folder, block_texts=100)
    q = spark.createDataFrame([(i, f"the of and x{i} x{i + 1} x{i + 2}") for i in range(20)], "query_id long, query_text string")
    scored = sum(r.scored for r in I.search(folder, q, 5).collect())
    assert scored < 20 * 3000 / 2
    assert [(r.query_id, r.doc_key, r["rank"]) for r in I.top_k(folder, q, 5).orderBy("query_id", "rank").collect()] == [(r.query_id, r.doc_key, r["rank"]) for r in V.bm25(df, q, 5).orderBy("query_id", "rank").collect()]


def test_scores_of_given_pairs(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    texts, queries = corpus(6, 80)
    folder = str(tmp_path / "bm25")
    df, q = spark.createDataFrame(texts, "doc_key long, text string"), spark.createDataFrame(queries, "query_id long, query_text string")
    I.build_index(df, folder, block_texts=16)
    pairs = df.crossJoin(q.select("query_id"))  # a small fixture
    got = sorted((r.query_id, r.doc_key, round(r.score, 6)) for r in I.score_pairs(folder, q, pairs).collect())
    assert got == [x[:3] for x in brute(texts, queries, 10**6)]


def test_empty(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    folder = str(tmp_path / "bm25")
    I.build_index(spark.createDataFrame([], "doc_key long, text string"), folder)
    assert I.top_k(folder, spark.createDataFrame([(1, "a")], "query_id long, query_text string"), 5).collect() == []


def test_postings_of_a_block(spark, tmp_path):
    """A word's texts, counts and lengths, numbered by key; empty texts count."""
    ensure_checkpoint_dir(spark)
    folder = str(tmp_path / "bm25")
    texts = [("b", "x y x"), ("a", None), ("c", "Y y,y  z_1"), ("d", "")]
    df = spark.createDataFrame(texts, "doc_key string, text string")
    I.build_index(df, folder)
    rows = {r.term: r for r in spark.read.parquet(f"{folder}/postings").collect()}
    assert set(rows) == {"", "x", "y", "z_1"} and rows[""].names == ["a", "b", "c", "d"] and (rows[""].df, rows[""].words) == (4, 7)
    assert (rows["y"].no, rows["y"].tf, rows["y"].n, rows["y"].most, rows["y"].least, rows["y"].df) == ([1, 2], [1, 3], [3, 4], 3, 3, 2)
    assert (rows["x"].no, rows["x"].tf, rows["x"].n) == ([1], [2], [3])


def test_a_block_adds_its_lists_without_sorting_them_again(monkeypatch):
    """The time of a search is that of (block, query) pairs with some forty lists each: no sorted set and no search of a set for each list."""
    import numpy as np

    g, calls = np.random.default_rng(4), []
    lists = [(float(b), np.sort(g.choice(512, 200, replace=False)), np.full(200, b / 2)) for b in np.linspace(0.1, 5, 40)]
    for f in ("unique", "searchsorted"):
        monkeypatch.setattr(np, f, lambda *a, f=getattr(np, f), **k: (calls.append(1), f(*a, **k))[1])
    want = np.zeros(512)
    for _, no, part in lists:
        want[no] += part
    best = sorted(((-round(float(s), 9), i) for i, s in enumerate(want)))[:5]
    for least in (0.0, 20.0, -best[4][0]):
        calls.clear()
        got, n = I.best_of_block(lists, 5, least)
        assert [(-round(s, 9), i) for s, i in got] == best and n <= 512 and len(calls) <= 1
