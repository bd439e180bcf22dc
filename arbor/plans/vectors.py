"""Queries of vector search with filters and of the vector index, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import retrieval as V
from arbor.operators import vector_search as X
from arbor.plans.base import NODES, nodes_of, query, scratch
from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S

#: What a sample must find of its ten nearest others when the number of cells to read is chosen.
TARGET = 0.93

_EXACT = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id,
 e.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(q.v, e.v))), 12) AS relevance FROM e, e q WHERE q.vec_id % 50 = 0)
 SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM s)
 WHERE rank <= 10"""


def _embeddings(spark, d):
    e = S.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("vec"))
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")


def _ranked(df):
    return df.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query("t01_top_k_blocks", _EXACT)
def blocks(spark, d):
    """As a query set above the bound goes: blocks of requests meet blocks of vectors."""
    e, q = _embeddings(spark, d)
    return _ranked(V.vector_top_k(q, e, 10, query_bound=0))


@query("t03_index_all_cells", _EXACT)
def index_exact(spark, d):
    ensure_checkpoint_dir(spark)
    e, q = _embeddings(spark, d)
    folder = scratch(spark, "vectors")
    X.build_index(e, folder)
    return _ranked(X.search_index(q, folder, 10, None))


@query("t03_index_recall", """SELECT count(*) * least(10, (SELECT count(*) FROM embeddings)) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0""")
def index_recall(spark, d):
    """How many of the ten nearest the index finds with probes chosen on a sample; enough: nine of ten or more."""
    ensure_checkpoint_dir(spark)
    e, q = _embeddings(spark, d)
    folder = scratch(spark, "vectors")
    X.build_index(e, folder)
    found = X.search_index(q, folder, 10, X.probes_for(spark, folder, 10, TARGET)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = V.vector_top_k(q, e, 10).select("query_id", "vec_id")
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("asked"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@query("t03_d11_index_appended", _EXACT)
def index_appended(spark, d):
    """A fifth of the vectors comes later, and a seventh stood there with another value before."""
    ensure_checkpoint_dir(spark)
    e, q = _embeddings(spark, d)
    folder = scratch(spark, "vectors")
    first = e.where("vec_id % 5 <> 2")
    X.build_index(first.withColumn("vec", F.when(F.col("vec_id") % 7 == 3, F.reverse("vec")).otherwise(F.col("vec"))), folder)
    X.append(e.where("vec_id % 5 = 2"), folder)
    X.upsert(first.where("vec_id % 7 = 3"), folder)
    return _ranked(X.search_index(q, folder, 10, None))


@query(
    "t02_r09_filtered_search",
    NODES + """, v AS (SELECT document_id, level_index, span_start, span_end, CAST(e.embedding AS DOUBLE[]) AS v FROM nodes
 JOIN embeddings e ON e.vec_id = (document_id * 31 + level_index) % 97 WHERE height = 0),
 q AS (SELECT doc_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS qv, 400 * (doc_id % 3) - 200 AS a, length(coalesce(text, '')) - doc_id % 700 AS b,
 CASE WHEN doc_id % 2 = 0 THEN length(coalesce(text, '')) - 500 END AS z FROM documents JOIN embeddings e ON e.vec_id = doc_id % 89)
 SELECT query_id, level_index, round(greatest(0.0, least(1.0, list_cosine_similarity(v, qv))), 9) AS relevance,
 row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, least(1.0, list_cosine_similarity(v, qv))), 12) DESC, level_index) AS rank
 FROM q JOIN v ON document_id = query_id WHERE span_start < b AND span_end > a AND (z IS NULL OR span_end < z) QUALIFY rank <= 5""",
)
def filtered(spark, d):
    """Every document has a request of its own, with a window and, for half of them, a horizon."""
    e, _ = _embeddings(spark, d)
    leaves = nodes_of(spark, d).where("height = 0").select("document_id", F.col("level_index").alias("leaf"), "span_start", "span_end", ((F.col("document_id") * 31 + F.col("level_index")) % 97).alias("vec_id"))
    vectors = leaves.join(e, "vec_id").select("document_id", F.col("leaf").alias("vec_id"), "vec", "span_start", "span_end")
    doc, n = F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))
    asked = S.read(spark, d, "documents").select(doc.alias("query_id"), doc.alias("document_id"), (doc % 89).alias("vec_id"), (400 * (doc % 3) - 200).alias("start"), (n - doc % 700).alias("end"), F.when(doc % 2 == 0, n - 500).alias("horizon"))
    found = X.top_k_join(asked.join(e, "vec_id"), vectors, 5, "document_id")
    return found.select("query_id", F.col("vec_id").alias("level_index"), F.round("relevance", 9).alias("relevance"), F.col("rank").cast("bigint").alias("rank"))
