"""The flagship query, over all benchmark items: BM25 relevance of leaves, coverage, scores, and a tiling of each hit document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.operators import inverted_index as I
from arbor.operators import retrieval as R
from arbor.plans.base import scratch
from arbor.sources import corpus as S


def flagship(spark: SparkSession, sf_dir: str, budget: int | None = 400, k: int = 20) -> DataFrame:
    docs, folder = S.read(spark, sf_dir, "documents"), scratch(spark, "leaves")
    asked = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    I.build_index(S.leaf_texts(docs).withColumnRenamed("id", "doc_key"), folder)
    share = (F.col("score") / (F.col("score") + 10)).alias("score")
    # an id says where a leaf is, so the seeds need no join, and only the documents that they are in are built
    at = F.split("doc_key", ":")
    place = [at[0].cast("bigint").alias("document_id"), at[1].cast("int").alias("height"), at[2].cast("bigint").alias("level_index")]
    seeds = I.top_k(folder, asked, k).select("query_id", *place, F.col("doc_key").alias("id"), "score").checkpoint()
    held = docs.join(seeds.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi").checkpoint()
    nodes = S.nodes(held)
    cover = R.coverage(seeds, nodes).checkpoint()
    beside = R.siblings(seeds).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").join(S.leaf_texts(held).select("id", "text"), "id")
    more = I.score_pairs(folder, asked, beside.withColumnRenamed("id", "doc_key"))
    known = seeds.select("query_id", F.col("id").alias("doc_key"), "score").unionByName(more)
    scores = R.with_siblings(seeds, known.select("query_id", "doc_key", share))
    return R.tile(cover, scores, asked.select("query_id", F.lit(budget).alias("budget")))
