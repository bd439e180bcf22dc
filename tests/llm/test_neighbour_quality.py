import zlib

import numpy as np
import pyarrow as pa

from arbor.llm import neighbour_quality as N
from arbor.llm.shared import table


def test_held_out_accuracy_and_whole_result(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = N.scores(docs, N.fit(docs, labels)).collect()
    q = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [(r.predicted, q[r.doc_id]) for r in rows if r.held_out and r.doc_id in q]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_votes_equal_brute_force():
    r = np.random.default_rng(1)
    x = r.random((80, N.WIDTH)).astype(np.float32)
    m = N.Model(x[:60], (r.random(60) < 0.5).astype(int), dims=8)
    p = m.project(x[60:])
    for row, got in zip(p, m.scores(x[60:])):
        s = np.sort(np.clip(m.points @ row, 0, 1) ** N.POWER)[-N.K :]
        w, y = s - s[0] * 0.999, m.y[np.argsort(np.clip(m.points @ row, 0, 1), kind="stable")[-N.K :]]
        e = N.PRIOR_WEIGHT * 1e-3
        assert abs(got - ((w * y).sum() + e * m.prior) / (w.sum() + e)) < 1e-9


def test_features_do_not_depend_on_the_batch():
    t = ["Hello  World, x", "", None, "A!! B!!\nline | line", "é ê 12.5%", "word " * 50]
    whole = N.features(pa.chunked_array([pa.array(t)]))
    assert all((N.features(pa.chunked_array([pa.array([x], pa.string())])) == w).all() for x, w in zip(t, whole))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "some text", 0.3)] + [(i, f"clean text number {i}, with words.", 0.0) for i in range(10, 60)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in N.scores(docs, N.fit(docs, none)).collect()} == {0.5}
    assert N.keep_good(docs, N.fit(docs, none)).count() == docs.count()
    some = spark.createDataFrame([(i, 1 if i % 3 else None) for i in range(10, 60)] + [(None, 1), (11, 1)], "doc_id long, quality int")
    model = N.fit(docs, some)
    assert len(N.scores(docs, model).collect()) == 53 and N.keep_good(docs, model).columns == docs.columns
    assert N.scores(docs.limit(0), model).collect() == []


def test_words_alone_tell_the_labels(spark):
    """Texts alike but for their words: the hashed words carry the decision."""
    r = np.random.default_rng(5)
    word = lambda kind: f"{'xyzqjk'[r.integers(6)]}{kind}{'aeiou'[r.integers(5)]}n"
    rows = [(i, " ".join(word("la" if i % 2 else "mo") for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = N.scores(docs, N.fit(docs, labels)).where("held_out").collect()
    assert sum(g.predicted == g.doc_id % 2 for g in got) / len(got) > 0.95


def test_very_long_text(spark):
    docs = spark.createDataFrame([(i, "plain words of a text, number " + str(i)) for i in range(40)] + [(99, "some words " * 400_000)], "doc_id long, text string")
    got = N.scores(docs, N.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))).collect()
    assert len(got) == 41 and all(0 <= g.score <= 1 for g in got)
