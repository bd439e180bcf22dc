import numpy as np
import pytest
from pyspark.sql import functions as F

from arbor.llm.metric_join import MOST_BLOCK, near_duplicates, parts_of, side_of, squares


def brute(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, link = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine or (a == b).all():
                    link[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] if rows[j][0] is not None else -1) for j in seen)
        out.append((rows[i][0], len(link[i]), None if low == -1 else low))
    return sorted(out, key=str)


@pytest.mark.parametrize("pivots,block", [(1, 7), (5, 16), (24, 4096)])
def test_equals_brute_force(spark, pivots, block):
    r = np.random.default_rng(pivots)
    rows = []
    for f in range(25):
        base = r.normal(size=6)
        for _ in range(r.integers(1, 8)):
            rows.append((len(rows), (base * r.uniform(0.1, 9) + r.normal(size=6) * r.choice([0, 0.05, 0.3])).tolist()))
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, None), (601, []), (602, [0.0] * 6), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] + [0.0] * 5), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (None, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, point string")
    got = near_duplicates(df, pivots=pivots, block=block).collect()
    assert sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=str) == brute(rows, 0.95)
    assert all(g.kept == (g.vec_id == g.component_id) for g in got if g.vec_id is not None)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_ties_at_the_threshold_are_seen_from_both_ends(spark):
    r = np.random.default_rng(3)
    rows, pairs = [], 60
    for k in range(pairs):
        a, b = np.linalg.qr(r.normal(size=(16, 2)))[0].T
        c = [0.95, np.nextafter(0.95, 0), np.nextafter(0.95, 1)][k % 3]
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (9, 4096):
        got = {g.vec_id: g.n_links for g in near_duplicates(df, pivots=5, block=block).collect()}
        assert len(got) == 2 * pairs and sum(got.values()) % 2 == 0 and all(got[2 * k] == got[2 * k + 1] for k in range(pairs))


def test_shuffled_rows_follow_their_law():
    assert side_of(51_282) == 4096 and side_of(10**6) == 8000 and side_of(10**9) == MOST_BLOCK


def test_a_vector_goes_to_one_square_a_part(spark):
    n = 6000
    side = 4 * side_of(n, 40)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(r.normal(size=(n, 32)))], "point long, times long, vec array<float>")
    rows = squares(df, 0.95, 24, 40)
    parts = rows.agg(F.max("hi")).first()[0] + 1
    assert parts <= 2 * n / side and rows.count() <= n * parts and dict(rows.dtypes)["vec"] == "array<float>"
    assert max(c["count"] for c in rows.groupBy("lo", "hi", "side").count().collect()) <= 1.1 * side


def test_cells_are_packed_into_parts():
    assert parts_of([3, 4, 25, 2, 9, 0, 10], 10) == [range(0, 1), range(0, 1), range(1, 4), range(4, 5), range(5, 6), range(5, 6), range(6, 7)]


def test_large_families_within_and_across_parts(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(3, 12))
    rows = [(i, (base[i % 3] + r.normal(size=12) * 0.01 * (i % 5)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = [(g.vec_id, list(map(float, g.embedding))) for g in df.collect()]
    for block in (3, 20, 4096):
        got = near_duplicates(df, pivots=4, block=block).collect()
        assert sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=str) == brute(held, 0.95)
