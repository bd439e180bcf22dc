from arbor.plans import registry as R

DIR = "/root/testdata/sf0.001"


def test_flagship_asks_every_item(spark):
    asked = {r.item_id for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id").collect()}
    got = {r.query_id for r in R.QUERIES["r18_flagship_tiling"](spark, DIR).select("query_id").distinct().collect()}
    assert len(asked) > 5 and got == asked


def test_pairwise_all_has_every_vector(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
    rows = R.QUERIES["r03_pairwise_all"](spark, DIR).select("a", "b").collect()
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in ids for b in ids if a % 50 == 0 and a != b}


def test_units_keep_their_tails(spark, tmp_path):
    long = "x" * 60_000
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", " \n"), (1, 2, "user", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = lambda name: {r.turn: r.text for r in R.QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("f10_g10_units_whole") == {0: long, 2: "y"}
    assert rows("f10_b20_client_units") == {0: long[:50_000], 1: " \n", 2: "y"}
