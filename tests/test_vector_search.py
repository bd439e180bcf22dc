import glob
import math
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from arbor.operators import retrieval as V
from arbor.operators import vector_search as X
from arbor.session import ensure_checkpoint_dir


def _vectors(n, seed=1, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, dim))[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 :: 7] = x[0]  # a third of a hot direction and ties
    return x


def _frame(spark, x, name, **more):
    cols = ", ".join(f"{c} long" for c in more)
    rows = [(i, v.tolist(), *[more[c][i] for c in more]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>" + (f", {cols}" if cols else ""))


def brute(q, x, k, allowed=lambda i, j: True):
    rel = np.round(np.clip(q @ x.T, 0, 1), 12)
    out = set()
    for i in range(len(q)):
        ok = sorted((-rel[i, j], j) for j in range(len(x)) if allowed(i, j))[:k]
        out |= {(i, j, n) for n, (_, j) in enumerate(ok, 1)}
    return out


def _rows(df):
    return {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("nv,nq", [(8192, 1024), (50, 7)])
def test_blocks_equal_brute_force(spark, nv, nq):
    x, q = _vectors(400), _vectors(30, 2)
    got = X.top_k_join(_frame(spark, q, "query_id"), _frame(spark, x, "vec_id"), 6, block_vectors=nv, block_requests=nq)
    assert _rows(got) == brute(q, x, 6)


@pytest.mark.parametrize("nv,nq", [(8192, 1024), (20, 3)])
def test_keys_windows_and_horizons(spark, nv, nq):
    """One key holds most vectors and requests; windows and horizons differ by request; some keys have no other side."""
    x, q, r = _vectors(300), _vectors(40, 3), np.random.default_rng(4)
    kx, kq = [int(k) if k < 9 else 1 for k in r.integers(0, 30, 300)], [int(k) if k < 11 else 1 for k in r.integers(0, 30, 40)]
    lo = [int(v) for v in r.integers(0, 900, 300)]
    hi = [v + 50 for v in lo]
    start, end = [int(v) if v > 100 else None for v in r.integers(0, 500, 40)], [int(v) if v < 900 else None for v in r.integers(400, 1000, 40)]
    z = [int(v) if v < 900 else None for v in r.integers(300, 1100, 40)]
    requests = _frame(spark, q, "query_id", doc=kq, start=start, end=end, horizon=z)
    vectors = _frame(spark, x, "vec_id", doc=kx, span_start=lo, span_end=hi)
    inf = float("inf")
    none = lambda v, d: d if v is None else v
    ok = lambda i, j: kq[i] == kx[j] and lo[j] < none(end[i], inf) and hi[j] > none(start[i], -inf) and hi[j] < none(z[i], inf)
    assert _rows(X.top_k_join(requests, vectors, 4, "doc", nv, nq)) == brute(q, x, 4, ok)


def test_no_requests_no_vectors_and_nulls(spark):
    x = _frame(spark, _vectors(20), "vec_id")
    none = spark.createDataFrame([], "query_id long, vec array<double>")
    assert X.top_k_join(none, x, 3).collect() == [] and V.vector_top_k(none, x, 3).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, None)], "query_id long, vec array<double>")
    assert X.top_k_join(nulls, x, 3).collect() == [] and X.top_k_join(_frame(spark, _vectors(3), "query_id"), x.limit(0), 3).collect() == []


def test_a_query_set_above_the_bound_gives_the_same(spark):
    x, q = _vectors(300), _vectors(25, 5)
    below = V.vector_top_k(_frame(spark, q, "query_id"), _frame(spark, x, "vec_id"), 5)
    above = V.vector_top_k(_frame(spark, q, "query_id"), _frame(spark, x, "vec_id"), 5, query_bound=24)
    assert _rows(below) == _rows(above) == brute(q, x, 5)


def _files(folder):
    return {os.path.basename(os.path.dirname(f)): os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/vectors/cell=*/*.parquet")}


def test_index(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    x, q, folder = _vectors(600), _vectors(40, 6), str(tmp_path / "index")
    all_rows = _frame(spark, x, "vec_id")
    n = X.build_index(all_rows.where("vec_id < 500"), folder, cells=16)
    assert 1 < n <= 16 and spark.read.parquet(f"{folder}/vectors").count() == 500
    asked = _frame(spark, q, "query_id")
    assert _rows(X.search_index(asked, folder, 5, None)) == brute(q, x[:500], 5)
    # a search reads the folders of the probed cells only
    plan = X.search_index(asked.where("query_id = 3"), folder, 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    # appended vectors get files in their own cells
    before = _files(folder)
    late = all_rows.where("vec_id >= 500 and vec_id < 510")
    cells = {f"cell={r.cell}" for r in X.with_cells(late, X._centers(spark, folder)).collect()}
    X.append(late, folder)
    after = _files(folder)
    assert {c for c in after if before.get(c) != after[c]} <= cells and spark.read.parquet(f"{folder}/vectors").count() == 510
    # replaced vectors leave their old cells
    X.upsert(spark.createDataFrame([(i, x[599 - i].tolist()) for i in range(5)], "vec_id long, vec array<double>"), folder)
    y = x[:510].copy()
    y[:5] = x[599:594:-1]
    assert _rows(X.search_index(asked, folder, 5, None)) == brute(q, y, 5)
    # probes chosen on a sample reach the recall asked for
    p = X.probes_for(spark, folder, 5, 0.95, sample=200)
    new = x[520:590]
    found = {(a, b) for a, b, _ in _rows(X.search_index(_frame(spark, new, "query_id"), folder, 5, p))}
    exact = {(a, b) for a, b, _ in brute(new, y, 5)}
    assert p < n and len(found & exact) >= 0.9 * len(exact)


def test_upsert_that_empties_a_cell(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    folder, x = str(tmp_path / "index"), np.eye(4)
    X.build_index(_frame(spark, x, "vec_id"), folder, cells=4)
    X.upsert(spark.createDataFrame([(i, x[0].tolist()) for i in range(4)], "vec_id long, vec array<double>"), folder)
    got = X.search_index(_frame(spark, x, "query_id"), folder, 9, None).collect()
    assert sorted((r.query_id, r.vec_id, r.relevance) for r in got) == [(i, j, float(i == 0)) for i in range(4) for j in range(4)]


def test_empty_index(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    folder = str(tmp_path / "index")
    assert X.build_index(spark.createDataFrame([], "vec_id long, vec array<double>"), folder) == 0
    assert X.search_index(_frame(spark, _vectors(3), "query_id"), folder, 3, None).collect() == []


def test_broken_and_absent_snapshots_are_empty_and_other_errors_raise(spark, tmp_path):
    from arbor.sources import files

    path, schema = str(tmp_path), "vec_id long, embedding array<float>"
    spark.range(1).selectExpr("'no parquet file' as value").write.text(f"{path}/broken")
    os.makedirs(f"{path}/nothing")
    for name in ("broken", "absent", "nothing"):
        assert files.load_vectors(spark, f"{path}/{name}", schema, whole=True).collect() == []
    with pytest.raises(Exception, match="nosuchscheme"):
        files.load_vectors(spark, "nosuchscheme://host/path", schema, whole=True)


def _peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_products_are_made_a_slice_at_a_time():
    r = np.random.default_rng(2)
    table = lambda n, name: pa.table({name: np.arange(n), "vec": pa.array(r.normal(size=(n, 4)).tolist(), pa.list_(pa.float64())), "__key": np.zeros(n, np.int64)})
    left, right = table(1000, "query_id"), table(8192, "vec_id")
    assert _peak(lambda: X._meet(5, False)(left, right)) < 40  # all products are 64 MB, and were held several times
    assert _peak(lambda: X._nearest(r.normal(size=(8000, 4)), r.normal(size=(1000, 4)), 1)) < 40


def test_a_batch_that_goes_to_many_cells_is_given_out_in_slices(spark):
    centers = np.eye(64)
    df = spark.createDataFrame([(i, [float(i == j) + 0.01 * j for j in range(64)]) for i in range(300)], "vec_id long, vec array<double>").coalesce(1)
    placed = X.with_cells(df, centers, 64)
    assert placed.count() == 300 * 64 and placed.select("vec_id", "cell").distinct().count() == 300 * 64


def test_small_keys_share_a_block_by_their_vectors(spark, monkeypatch):
    """Three hundred keys of two vectors are one block, not one for every few keys."""
    def one_row(k, windowed):
        def run(left, right):
            return pa.table({"query_id": left["query_id"][:1], "vec_id": pa.array([len(right)], pa.int64()), "relevance": pa.array([1.0])})

        return run

    q = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(300)], "query_id long, doc long, vec array<double>")
    x = spark.createDataFrame([(i, i % 300, [0.5, float(i)]) for i in range(600)], "vec_id long, doc long, vec array<double>")
    got = {(r.query_id, r.vec_id) for r in X.top_k_join(q, x, 1, "doc").collect()}
    assert got == {(i, i) for i in range(300)}
    monkeypatch.setattr(X, "_meet", one_row)
    assert [r.vec_id for r in X.top_k_join(q, x, 1, "doc").collect()] == [600]


@pytest.mark.parametrize("few", [0, 10_000])
def test_keys_of_several_blocks_among_many(spark, monkeypatch, few):
    """Also where there are too many keys for all of them to go to every task."""
    monkeypatch.setattr(X, "MANY_BLOCKS", few)
    q = spark.createDataFrame([(i, i % 40, [1.0, i / 9]) for i in range(80)] + [(99, None, [1.0, 1.0])], "query_id long, doc long, vec array<double>")
    rows = [(i, 3 if i % 2 else i % 50, [math.cos(i), math.sin(i)]) for i in range(1500)]
    x = spark.createDataFrame(rows, "vec_id long, doc long, vec array<double>")
    got = {}
    for r in X.top_k_join(q, x, 3, "doc", 200, 1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in range(80):
        rel = {v: round(min(1.0, max(0.0, w[0] + w[1] * i / 9)), 12) for v, d, w in rows if d == i % 40}
        assert [v for _, v in sorted(got.get(i, []))] == sorted(rel, key=lambda v: (-rel[v], v))[:3]
    assert 99 not in got


@pytest.mark.parametrize("nv,nq", [(8192, 1024), (20, 3)])
def test_candidates_come_with_what_is_asked_of_their_vectors(spark, nv, nq):
    """Nearest vectors and those of another search, with their and their siblings' products, also where a document is many blocks."""
    x, q, r = _vectors(300), _vectors(40, 3), np.random.default_rng(5)
    doc = [1 if i < 200 else 2 + i // 30 for i in range(300)]
    asked = [1 if i % 3 else 9 for i in range(40)]
    scale = [1.0 + i % 4 for i in range(300)]
    texts = [[(int(v), n) for n, v in enumerate(r.choice(320, 5, replace=False), 1)] if i % 2 else None for i in range(40)]
    rows = [(i, asked[i], v.tolist(), None, None, 250 if i % 5 == 0 else None, texts[i], i % 4 != 0, 1 + i % 6) for i, v in enumerate(q)]
    requests = spark.createDataFrame(rows, "query_id long, doc long, vec array<double>, start long, end long, horizon long, texts array<struct<leaf:long,rank:int>>, keep boolean, k long")
    vectors = spark.createDataFrame([(i, doc[i], (v * scale[i]).tolist(), scale[i], i, i + 1) for i, v in enumerate(x)], "vec_id long, doc long, vec array<double>, norm double, span_start long, span_end long")
    got = {}
    for c in X.candidates_join(requests, vectors, "doc", ["doc", "k"], nv, nq).collect():
        assert (c.query_id, c.vec_id) not in got and c.doc == asked[c.query_id] == doc[c.vec_id] and c.k == 1 + c.query_id % 6
        got[c.query_id, c.vec_id] = c
    for i in range(40):
        own = {j: round(min(1.0, max(0.0, float(q[i] @ x[j]))), 12) for j in range(300) if doc[j] == asked[i]}
        k, ok = 1 + i % 6, [j for j in own if i % 5 or j + 1 < 250]
        mine = {j: c for (a, j), c in got.items() if a == i}
        near = sorted((j for j, c in mine.items() if c.relevance is not None), key=lambda j: (-mine[j].relevance, j))[:k]
        assert near == sorted(ok, key=lambda j: (-own[j], j))[:k]
        assert {j: c.text_rank for j, c in mine.items() if c.text_rank is not None} == {j: n for j, n in texts[i] or () if j in own}
        for j, c in mine.items():
            assert abs(c.score - own[j]) < 1e-9 and (c.beside is None) == (j ^ 1 not in own) and (c.vec is None) == (i % 4 == 0)
            assert c.beside is None or abs(c.beside - own[j ^ 1]) < 1e-9
            assert c.vec is None or np.allclose(np.array(c.vec) / c.norm, x[j])
