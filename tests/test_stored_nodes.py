import glob
import os

from pyspark.sql import functions as F

from arbor.operators import repository as R
from arbor.operators import stored_nodes as W
from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S


def _nodes(spark):
    ensure_checkpoint_dir(spark)
    docs = spark.createDataFrame([(d, "x" * (400 * (d % 7) + d)) for d in range(40)] + [(100, None)], "doc_id long, text string")
    return S.nodes(docs)


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/nodes/bucket=*/*.parquet")}


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def _bucket_of(spark, path, doc):
    return spark.read.parquet(f"{path}/nodes").where(f"document_id = {doc}").select("bucket").distinct().first().bucket


def test_changes_write_only_their_buckets(spark, tmp_path):
    n, path = _nodes(spark), str(tmp_path / "t")
    W.create(n, path, 8)
    assert _rows(W.read(spark, path)) == _rows(n)
    for doc, change in ((3, lambda p: W.upsert(n.where("document_id = 3").withColumn("token_count", F.lit(1).cast("long")), p)), (4, lambda p: W.delete(n.where("document_id = 4").select("id", "document_id"), p)), (6, lambda p: W.truncate(spark.createDataFrame([(6, 800)], "document_id long, position long"), p))):
        own, before = f"bucket={_bucket_of(spark, path, doc)}", _files(path)
        assert change(path) == 1
        after = _files(path)
        assert {f for f in before if own not in f} == {f for f in after if own not in f} and all(before[f] == after[f] for f in before if own not in f)
        assert not set(f for f in before if own in f) & set(after)
    left = W.read(spark, path)
    assert left.where("document_id = 4").count() == 0 and left.where("document_id = 3 and token_count <> 1").count() == 0
    assert _rows(left.where("document_id = 6")) == _rows(R.truncate_from(n.where("document_id = 6"), 800))
    assert _rows(left.where("document_id not in (3, 4, 6)")) == _rows(n.where("document_id not in (3, 4, 6)"))


def test_height_stays_and_new_nodes_come(spark, tmp_path):
    n, path = _nodes(spark), str(tmp_path / "t")
    W.create(n, path, 4)
    one = n.where("id = '6:1:0'").withColumn("height", F.lit(9)).withColumn("token_count", F.lit(5).cast("long"))
    new = one.withColumn("id", F.lit("200:0:0")).withColumn("document_id", F.lit(200).cast("long"))
    W.upsert(one.unionByName(new), path)
    got = {r.id: (r.height, r.token_count) for r in W.read(spark, path).where("id in ('6:1:0', '200:0:0')").collect()}
    assert got == {"6:1:0": (1, 5), "200:0:0": (9, 5)}


def test_nothing_to_change_and_documents_that_are_not_there(spark, tmp_path):
    n, path = _nodes(spark), str(tmp_path / "t")
    W.create(n, path, 4)
    before = _files(path)
    assert W.delete(n.where("false").select("id", "document_id"), path) == 0 and _files(path) == before
    W.truncate(spark.createDataFrame([(999, 0)], "document_id long, position long"), path)
    W.delete(spark.createDataFrame([("999:0:0", 999)], "id string, document_id long"), path)
    W.bulk_update(spark.createDataFrame([("999:0:0", 999, 3)], "id string, document_id long, token_count long"), path)
    assert _rows(W.read(spark, path)) == _rows(n)


def test_everything_goes_and_comes_back(spark, tmp_path):
    n, path = _nodes(spark), str(tmp_path / "t")
    W.create(n, path, 4)
    W.truncate(n.select("document_id").distinct().withColumn("position", F.lit(-1)), path)
    assert W.read(spark, path).collect() == []
    W.upsert(n, path)
    assert _rows(W.read(spark, path)) == _rows(n)


def test_bulk_update_sets_nulls_too(spark, tmp_path):
    n, path = _nodes(spark), str(tmp_path / "t")
    W.create(n, path, 4)
    W.bulk_update(spark.createDataFrame([("6:0:0", 6, None, 11), ("5:0:0", 5, "p", None)], "id string, document_id long, parent_id string, token_count long"), path)
    got = {r.id: (r.parent_id, r.token_count) for r in W.read(spark, path).where("id in ('6:0:0', '5:0:0')").collect()}
    assert got == {"6:0:0": (None, 11), "5:0:0": ("p", None)}
