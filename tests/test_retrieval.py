from pyspark.sql import functions as F

from arbor.operators import retrieval as R
from arbor.operators.retrieval import greedy_tiling, propagate, with_siblings


def _cover(spark):
    rows = [(1, 7, f"7:{h}:{i}", f"7:{h + 1}:{i >> 1}" if h < 2 else None, h, i, i * 10 << h, (i + 1) * 10 << h, 200) for h in range(3) for i in range(4 >> h)]
    return spark.createDataFrame(rows, "query_id long, document_id long, id string, parent_id string, height int, level_index long, span_start long, span_end long, token_count long")


def test_scores_are_means_of_scored_children(spark):
    leaf = spark.createDataFrame([(1, "7:0:0", 0.8), (1, "7:0:1", 0.4)], "query_id long, id string, score double")
    got = {r.id: r.score for r in propagate(_cover(spark), leaf).collect()}
    assert got["7:0:2"] is None and abs(got["7:1:0"] - 0.6) < 1e-12 and got["7:1:1"] == 0.0 and abs(got["7:2:0"] - 0.3) < 1e-12


def test_tiling_covers_once_within_budget_or_is_the_root(spark):
    leaf = spark.createDataFrame([(1, "7:0:0", 0.8), (1, "7:0:1", 0.8)], "query_id long, id string, score double")
    cover = _cover(spark)
    scored = cover.join(propagate(cover, leaf), ["query_id", "id"])
    for budget, n in ((800, 4), (600, 3), (400, 2), (200, 1), (1, 1)):
        t = sorted(greedy_tiling(scored, budget).collect(), key=lambda r: r.position)
        assert len(t) == n and t[0].span_start == 0 and t[-1].span_end == 40
        assert all(a.span_end == b.span_start for a, b in zip(t, t[1:])) and t[0].over_budget == (budget < 200)
    assert [r.id for r in sorted(greedy_tiling(scored, 600).collect(), key=lambda r: r.position)][0] == "7:0:0"


def test_siblings_of_seeds_are_scored(spark):
    seeds = spark.createDataFrame([(1, 7, 0, 0), (1, 7, 0, 3)], "query_id long, document_id long, height int, level_index long")
    scores = spark.createDataFrame([(1, "7:0:0", 0.8), (1, "7:0:1", 0.2), (1, "7:0:3", 0.6), (2, "7:0:2", 0.9)], "query_id long, doc_key string, score double")
    leaf = with_siblings(seeds, scores)
    got = {r.id: r.score for r in propagate(_cover(spark), leaf).collect()}
    assert got["7:0:1"] == 0.2 and got["7:0:2"] == 0.0 and abs(got["7:1:0"] - 0.5) < 1e-12 and abs(got["7:1:1"] - 0.3) < 1e-12


def test_flagship_scores_siblings(spark):
    from arbor.plans import registry as R

    rows = R.QUERIES["r18_flagship_tiling"](spark, "/root/testdata/sf0.001").where("height = 0").collect()
    ids = {(r.query_id, r.id): r.score for r in rows}
    seeds = [k for k, v in ids.items() if v]
    sib = lambda i: ":".join([*i.split(":")[:2], str(int(i.split(":")[2]) ^ 1)])
    pairs = [(q, sib(i)) for q, i in seeds if (q, sib(i)) in ids]
    assert pairs and all(ids[p] is not None for p in pairs)


def _okapi_rows(spark, few, monkeypatch=None):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [(d, f"{d}:{i}", i, " ".join(words[(d + i * j) % 5] for j in range(1 + (d + i) % 7)) if (d + i) % 6 else None) for d in range(4) for i in range(9)]
    t = spark.createDataFrame(texts, "document_id long, doc_key string, position int, text string")
    q = spark.createDataFrame([(1, 0, "alpha beta beta"), (2, 0, "Gamma nowhere"), (3, 1, "delta alpha omega"), (4, 2, None), (5, 9, "alpha")], "query_id long, document_id long, query_text string")
    if few is not None:
        monkeypatch.setattr(R, "FEW_TERMS", few)
    return R.okapi(t, q, 6), texts, q.collect()


def test_okapi_keeps_asked_words_only_or_all_of_them(spark, monkeypatch):
    a = sorted((r.query_id, r.rank, r.doc_key, round(r.score, 9)) for r in _okapi_rows(spark, None)[0].collect())
    b = sorted((r.query_id, r.rank, r.doc_key, round(r.score, 9)) for r in _okapi_rows(spark, 1, monkeypatch)[0].collect())
    assert a == b and {q for q, *_ in a} == {1, 2, 3, 4} and len(a) == 4 * 6
    assert all(s == 0 for q, _, _, s in a if q == 4) and [k for q, _, k, _ in a if q == 4] == [f"2:{i}" for i in range(6)]


def test_okapi_joins_no_row_of_a_word_that_nobody_asks_for(spark):
    """No join by words carries the words of texts before those not asked for are gone."""
    found, _, _ = _okapi_rows(spark, None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "regexp_extract_all" in plan and plan.count("explode(t") == 0


def test_small_groups_go_through_arrow_without_a_data_frame_each(spark):
    leaf = spark.createDataFrame([(1, "7:0:0", 0.8)], "query_id long, id string, score double")
    found = spark.createDataFrame([(1, i, 1 - i / 10, i, [1.0, i / 10]) for i in range(5)] + [(2, 9, 0.5, 1, [1.0, 0.0])], "query_id long, vec_id long, relevance double, rank int, vec array<double>")
    chosen = R.mmr(found, 3)
    for df in (propagate(_cover(spark), leaf), chosen):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = sorted((r.query_id, r.position, r.vec_id) for r in chosen.collect())
    assert [(q, p) for q, p, _ in got] == [(1, 1), (1, 2), (1, 3), (2, 1)] and got[0][2] == 0 and got[3][2] == 9


def test_okapi_reads_its_texts_once(spark):
    _, texts, _ = _okapi_rows(spark, None)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    kind = "document_id long, doc_key string, position int, text string"
    t = spark.createDataFrame(texts, kind).mapInArrow(counted, kind)
    q = spark.createDataFrame([(1, 0, "alpha beta beta"), (2, 3, "omega")], "query_id long, document_id long, query_text string")
    assert R.okapi(t, q, 6).count() == 12
    assert read.value == len(texts)


def test_mmr_of_sorted_candidates_is_a_stream(spark):
    """The same choice as by groups, over the ends of batches; without vectors where there is nothing to choose."""
    rows = [(q, i, 1 - (i * 7 + q) % 10 / 10, 1 + (i * 3) % (1 + q), [1.0 + q, (i * 5 + q) % 7 / 7, i % 3 / 3], 2.0, q // 2) for q in range(1, 12) for i in range(1 + q)]
    x = spark.createDataFrame(rows, "query_id long, vec_id long, relevance double, rank long, vec array<double>, norm double, take long")
    want = {(r.query_id, r.vec_id): r.position for r in R.mmr(x.where("take > 0"), None).collect()}
    few = x.withColumn("take", F.when(F.col("query_id") % 3 == 0, 40).otherwise(F.col("take"))).withColumn("vec", F.when(F.col("query_id") % 3 > 0, F.col("vec")))
    found = R.mmr(few.repartition("query_id"), None, carried=["rank"])
    assert "GroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for r in got:
        assert r.position == (r["rank"] if r.query_id % 3 == 0 else want.get((r.query_id, r.vec_id)))
