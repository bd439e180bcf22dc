"""Errors, restarts and equivalences that the queries with SQL do not show."""

import random
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from arbor.operators import build as B
from arbor.operators import catalog as G
from arbor.operators import metrics as M
from arbor.operators import query_path as P
from arbor.operators import repository as R
from arbor.operators import retrieval as V
from arbor.operators import validation as C
from arbor.plans import checks
from arbor.sources import corpus as S
from arbor.sources import files as X
from arbor.streaming import builder

DIR = "/root/testdata/sf0.001"


def _nodes(spark):
    return S.nodes(S.read(spark, DIR, "documents"))


def test_filters_translate_or_raise(spark):
    n = _nodes(spark)
    assert n.where(G.translate({})).count() == n.count()
    with pytest.raises(G.UnsupportedFilterError, match="colour"):
        G.translate({"document_id": 1, "colour": "red"})


def test_changes_that_must_fail(spark):
    n = _nodes(spark)
    with pytest.raises(ValueError):
        G.insert(n, n.where("document_id = 3"))
    cat = spark.createDataFrame([(1, False)], "document_id long, is_temporal boolean")
    with pytest.raises(KeyError):
        G.set_temporal(cat, spark.createDataFrame([(2, True)], "document_id long, is_temporal boolean"))
    tiles = spark.createDataFrame([(1, 1, None, None, None)], "query_id long, document_id long, id string, span_start long, token_count long")
    with pytest.raises(Exception, match="empty tiling"):
        G.query_log(tiles)[0].collect()
    with pytest.raises(Exception, match="zero vector"):
        G.upsert_vectors(spark.createDataFrame([], "id long, vec array<double>"), spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")).collect()


def test_insert_returns_rows_of_small_batches_only(spark):
    n = _nodes(spark)
    assert G.insert(n.where("height = 0"), n.where("height > 0"), most=5)[1].count() == 0
    assert G.insert(n.where("height = 0"), n.where("height = 3"), most=500)[1].count() == n.where("height = 3").count()


def test_requests_and_windows(spark):
    df = spark.createDataFrame([(5, None), (None, 3), (None, 0), (7, 2)], "b int, s int")
    assert [r[0] for r in df.select(P.request_mode(F.col("b"), F.col("s"))).collect()] == ["budget", "seeds", "structure", "budget+seeds"]
    with pytest.raises(Exception, match="needs a budget"):
        spark.createDataFrame([(None, None)], "b int, s int").select(P.request_mode(F.col("b"), F.col("s"))).collect()
    w = spark.createDataFrame([(5, 5, 9), (9, 12, 9), (0, 3, 9)], "a int, b int, n int")
    assert [r[0] for r in w.select(P.window_error(F.col("a"), F.col("b"), F.col("n"))).collect()] == ["window.empty", "window.outside", None]


@pytest.mark.parametrize("bad", ["2024-01-01T00:00:00", "yesterday", "2024-01-01 00:00:00Z", ""])
def test_times_need_a_zone(spark, bad):
    with pytest.raises(Exception, match="no time with a zone"):
        spark.createDataFrame([(bad,)], "t string").select(B.iso_seconds(F.col("t"))).collect()


def test_times_with_zones(spark):
    rows = [("1970-01-01T00:00:10Z",), ("1970-01-01T02:00:00+02:00",), ("1970-01-01T00:00:00.250+00:00",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(B.iso_seconds(F.col("t"))).collect()] == [10.0, 0.0, 0.25, None]


def test_units_that_must_fail(spark):
    one = spark.createDataFrame([("1970-01-01T00:00:10Z", None)], "time_start string, time_end string")
    with pytest.raises(Exception, match="both times or none"):
        B.parse_units(one).collect()
    back = spark.createDataFrame([("1970-01-01T00:00:10Z", "1970-01-01T00:00:09Z")], "time_start string, time_end string")
    with pytest.raises(Exception, match="ends before it starts"):
        B.parse_units(back).collect()
    none = spark.createDataFrame([], "document_id bigint, level_index bigint, span_start bigint, span_end bigint, token_count bigint, time_start double, time_end double")
    u = lambda *rows: spark.createDataFrame(list(rows), builder.UNITS)
    first = B.append(none, u((1, 0, 10, 1.0, 2.0), (2, 0, 5, None, None)))
    assert B.append(first, u((1, 1, 4, 3.0, 3.0), (2, 1, 4, None, None))).count() == 2
    with pytest.raises(Exception, match="with and without times"):
        B.append(first, u((1, 1, 4, None, None))).collect()


def test_a_batch_that_comes_again_changes_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    u = lambda a, b: spark.createDataFrame([(d, k, 7 + k, float(k), float(k)) for d in (1, 2) for k in range(a, b)], builder.UNITS)
    builder.add_batch(u(0, 3), 0, path)
    builder.add_batch(u(3, 9), 1, path)
    once = sorted(map(str, builder.nodes_at(spark, path).collect()))
    builder.add_batch(u(3, 9), 1, path)
    assert sorted(map(str, builder.nodes_at(spark, path).collect())) == once
    leaves = builder.nodes_at(spark, path).where("height = 0").drop("height", "batch")
    assert leaves.count() == 18 and builder.nodes_at(spark, path).where("height > 0").count() == B.parents(leaves).count() == 2 * 7


def test_one_pass_finds_what_the_checks_find(spark):
    n = checks.broken(_nodes(spark)).where("document_id % 12 <> 10")
    one = sorted(map(tuple, C.validate(n).collect()))
    each = sorted(tuple(r) for c in C.CHECKS for r in c(n).collect())
    assert one == each and len({r[1] for r in one}) >= 11
    assert C.validate(_nodes(spark)).count() == 0


def test_quantiles_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [("hot", r.choice([1.5, 2.0, r.random()])) for _ in range(900)] + [("b", r.random()) for _ in range(7)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x.q for x in M.linear_quantiles(M.positions(df, ["k"], "v"), ["k"], "v", {"q": 0.3}).collect()}
    want = {x.k: x.q for x in df.where("v is not null").groupBy("k").agg(F.expr("percentile(v, 0.3)").alias("q")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_versions_of_two_writers(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    names = []
    ts = [threading.Thread(target=lambda k=k: names.append(X.write_version(spark.range(k, k + 1), path))) for k in range(4)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    seen = X.versions(spark, path).collect()
    assert sorted(r.n for r in seen) == [1, 2, 3, 4] and {r.name for r in seen} == set(names)
    assert X.load_vectors(spark, f"{path}/none", "a long").collect() == []


def test_top_k_with_ties_and_bounds(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(50)] + [(99, None)], "vec_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, vec array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in V.vector_top_k(q, v, 3).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    for bound in ({"query_bound": 1}, {"byte_bound": 8}):  # a larger query set is dealt in blocks and gives the same
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in V.vector_top_k(q, v, 3, **bound).collect()) == got


def test_leaf_at_long_leaves(spark):
    n = spark.createDataFrame([("a", 1, 0, 0, 0, 10_000), ("b", 1, 0, 1, 10_000, 10_000), ("c", 1, 0, 2, 10_000, 10_001)], "id string, document_id long, height int, level_index long, span_start long, span_end long")
    p = spark.createDataFrame([(1, k) for k in (0, 4095, 4096, 9999, 10_000, 10_001)], "document_id long, position long")
    assert sorted((r.position, r.id) for r in R.leaf_at(n, p).collect()) == [(0, "a"), (4095, "a"), (4096, "a"), (9999, "a"), (10_000, "c")]


def test_batches_by_items_and_tokens(spark):
    rows = [(1, k, t) for k, t in enumerate([5, 5, 5, 20, 1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "d long, k long, t long")
    assert [r.batch for r in B.batches(df, "d", "k", "t", 3, 12).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_reverts_and_late_records(spark):
    i = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "session long, uuid long, ts long")
    log = spark.createDataFrame([(1, 1, 10), (1, 9, 5), (1, 4, 25), (2, 7, 1)], "session long, uuid long, ts long")
    got = sorted((r.session, r.uuid, r.action) for r in B.sync_actions(i, log).collect())
    assert got == [(1, 1, "keep"), (1, 2, "delete"), (1, 3, "delete"), (1, 4, "append"), (1, 9, "late"), (2, 7, "append")]


def test_batches_of_long_keys_run_on_over_arrow_batches(spark):
    rng = random.Random(5)
    rows = [(k % 3 if k % 7 else None, k, rng.choice([0, 1, 5, 9, None])) for k in range(4000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.d, r.k): r.batch for r in B.batches(spark.createDataFrame(rows, "d long, k long, t long"), "d", "k", "t", 4, 12).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for d in {r[0] for r in rows}:
        batch, held = 0, []
        for _, k, t in (r for r in rows if r[0] == d):
            if held and (len(held) >= 4 or sum(held) + (t or 0) > 12):
                batch, held = batch + 1, []
            held.append(t or 0)
            want[d, k] = batch
    assert got == want
    assert B.batches(spark.createDataFrame([], "d long, k long, t long"), "d", "k", "t", 4, 12).count() == 0


def test_verbatim_leaves_fill_the_budget_from_the_right(spark):
    rng = random.Random(6)
    rows = [(k % 4, f"{k}", rng.choice([0, 3, 40, 90]), k * 10, k * 10 + 10, k) for k in range(600)] + [(9, "n", None, 0, 1, 0)]
    df = spark.createDataFrame(rows, "document_id long, id string, token_count long, span_start long, span_end long, level_index long")
    for budget in (0, 1, 100):
        want = set()
        for d in range(4):
            left, got = budget, []
            for r in sorted((r for r in rows if r[0] == d), key=lambda r: -r[4]):
                if budget and r[2] <= left:
                    left -= r[2]
                    got.append(r)
            want |= {(d, min(r[3] for r in got), r[1]) for r in got}
        assert {tuple(r) for r in P.verbatim_leaves(df, budget).collect()} == want


def test_similarities_in_squares_are_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(q), k, x[k].tolist()) for k in range(90) for q in ([1] if k < 60 else [1, 2])] + [(1, 900, None), (3, 901, None)]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, vec array<double>")
    for block in (7, 512):
        got = {(r.query_id, r.a, r.b): r.similarity for r in V.similarities(df, df, block).collect()}
        want = {(q, a, b): max(0.0, min(1.0, float(x[a] @ x[b]))) for q, ids in ((1, range(90)), (2, range(60, 90))) for a in ids for b in ids if a != b}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_mmr_takes_the_best_balance_at_every_step(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 6))
    x[5] = x[4]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rel = [max(0.0, float(x[0] @ v)) for v in x]
    order = sorted(range(40), key=lambda i: (-rel[i], i))
    rows = [(1, i, rel[i], n + 1, x[i].tolist()) for n, i in enumerate(order)]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, relevance double, rank long, vec array<double>")
    for k in (1, 5, 12, 60):
        chosen = []
        while len(chosen) < min(k, 40):
            value = lambda i: rel[i] if not chosen else 0.7 * rel[i] - (1 - 0.7) * max([0.0, *(float(np.clip(x[i] @ x[c], 0, 1)) for c in chosen)])  # noqa: E731,B023
            chosen.append(max((i for i in order if i not in chosen), key=value))
        got = [r.vec_id for r in sorted(V.mmr(df, k).collect(), key=lambda r: r.position)]
        assert got == chosen
