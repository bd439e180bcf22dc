"""Queries of depths, windows, prefixes and hybrid retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbor.operators import navigation as N
from arbor.operators import repository as R
from arbor.operators import retrieval as V
from arbor.plans.base import NODES, ORACLES, nodes_of, query, simple
from arbor.sources import corpus as S


def _sizes(spark, d):
    return S.sizes(S.read(spark, d, "documents"))


@query("c11_s12_depth")
def depth(spark, d):
    return N.depth(nodes_of(spark, d), _sizes(spark, d)).select("id", "depth").where("depth <= 2")


ORACLES["c11_s12_depth"] = NODES.replace("WITH s", "WITH RECURSIVE s", 1) + """, c AS (SELECT id, parent_id, 0 AS depth FROM nodes UNION ALL SELECT c.id, p.parent_id, depth + 1 FROM c
 JOIN nodes p ON c.parent_id = p.id) SELECT id, CAST(max(depth) AS INT) AS depth FROM c GROUP BY 1 HAVING max(depth) <= 2"""


@query("r12_r13_window_bounds", """, wd AS (SELECT document_id, n_leaves // 5 AS lo, n_leaves - 1 - n_leaves // 4 AS hi, length(bin(n_leaves)) - 1 AS
 top FROM s),
 a AS (SELECT document_id, lo, hi, max(h) AS left_height FROM (SELECT *, unnest(range(0, top + 1)) AS h FROM wd)
 WHERE lo % (1 << h) = 0 AND lo + (1 << h) - 1 <= hi GROUP BY ALL), b AS (SELECT document_id, max(h) AS right_height
 FROM (SELECT *, unnest(range(0, top + 1)) AS h FROM wd) WHERE (hi + 1) % (1 << h) = 0 AND hi + 1 - (1 << h) >= lo GROUP BY ALL)
 SELECT document_id, lo, hi, CAST(left_height AS INT) AS left_height, CAST(right_height AS INT) AS right_height, lo >> left_height AS left_index, hi
 >> right_height AS right_index FROM a JOIN b USING (document_id)""", nodes=True)
def window_bounds(spark, d):
    n = F.col("n_leaves")
    from arbor.functions import coords as K

    w = _sizes(spark, d).select("document_id", F.floor(n / 5).alias("lo"), (n - 1 - F.floor(n / 4)).alias("hi"), K.max_height(n).alias("top"))
    return N.window_bounds(w).drop("top")


simple("r25_prefix", lambda n: N.prefix(n.where("height = 0")).select("leaf_id", "height", "level_index"), """, t AS (SELECT n.*, CASE WHEN parent_id IS NULL THEN NULL ELSE (((level_index >> 1) + 1) << (height + 1)) END
 AS parent_end FROM nodes n) SELECT l.id AS leaf_id, t.height, t.level_index FROM nodes l JOIN t USING (document_id)
 WHERE l.height = 0 AND ((t.level_index + 1) << t.height) <= l.level_index AND (t.parent_end IS NULL OR t.parent_end > l.level_index)""")
simple("v11_leaf_depth", lambda n: N.leaf_depth(n.where("not (height = 0 and level_index = 2)")), "SELECT document_id, 'leaf.depth' AS code, id AS node_id FROM nodes WHERE height = 1 AND level_index = 1")


def _contexts(n):
    leaves = N.contexts(n.where("height = 0"))
    broken = F.when(F.col("level_index") % 16 == 3, F.lit("[1,")).when(F.col("level_index") % 16 == 8, F.lit("[]")).otherwise(F.col("context"))
    return N.check_contexts(leaves.withColumn("context", broken), n.where("not (height = 2 and level_index = 0)"))


simple("v13_contexts", _contexts, """SELECT document_id, CASE WHEN level_index % 16 = 3 THEN 'context.parse' WHEN level_index % 16 = 8 THEN
 'context.end' ELSE 'context.missing' END AS code, id AS node_id FROM nodes
 WHERE height = 0 AND (level_index % 16 = 3 OR (level_index % 16 = 8 AND span_start > 0) OR level_index >> 2 = 1) UNION ALL
 SELECT document_id, 'context.gap', id FROM nodes WHERE 1 = 0""")
simple("r08_r09_seed_count", lambda n: R.document_status(n).select("document_id", N.seed_count(F.lit(1000), F.col("avg_leaf_tokens")).alias("seeds")), """SELECT document_id, CASE WHEN l > 0 THEN greatest(1, 1000 // l) ELSE 10 END AS seeds
 FROM (SELECT document_id, CAST(sum(token_count) AS BIGINT) // count(*) AS l FROM nodes WHERE height = 0 GROUP BY 1)""")
simple("r20_verbatim_horizon", lambda n: R.recent_leaves(n, 150).groupBy("document_id").agg(F.min("span_start").alias("horizon"), F.sum("token_count").alias("tokens"), F.count("*").alias("n")), """, l AS (SELECT *, sum(token_count) OVER (PARTITION BY document_id ORDER BY span_end DESC, level_index DESC
 ROWS UNBOUNDED PRECEDING) AS running FROM nodes WHERE height = 0) SELECT document_id, min(span_start) AS horizon, CAST(sum(token_count) AS BIGINT)
 AS tokens, count(*) AS n FROM l WHERE running - token_count < 150 GROUP BY 1""")
simple("r16_coverage_roots", lambda n: N.coverage_roots(n.where("level_index % 3 <> 1").withColumn("query_id", F.col("document_id"))).select("query_id", "id"), ", m AS (SELECT * FROM nodes WHERE level_index % 3 <> 1) SELECT document_id AS query_id, id FROM m WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM m)")


@query("r24_time_to_span", """WITH u AS (SELECT conv_id AS document_id, turn * 60.0 AS t, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS a,
 CAST(sum(length(text)) OVER w AS BIGINT) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
 SELECT document_id, min_by(a, t) FILTER (t >= 60) AS span_start, max_by(b, t) FILTER (t <= 200) AS span_end FROM u GROUP BY 1
 HAVING count(*) FILTER (t >= 60) > 0""")
def time_to_span(spark, d):
    u = S.units(S.read(spark, d, "conversations"))
    a = u.groupBy("document_id").agg(F.min(F.when(F.col("time_end") >= 60, F.struct("time_end", "span_start"))).alias("a"), F.max(F.when(F.col("time_start") <= 200, F.struct("time_start", "span_end"))).alias("b"))
    return a.select("document_id", "a.span_start", "b.span_end").where("span_start is not null")


@query("r06_hybrid", """WITH a AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY user_id
 ORDER BY value DESC, event_id) AS r FROM events WHERE user_id % 4 <> 0
 QUALIFY r <= 20), b AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r
 FROM events QUALIFY r <= 20), f AS (SELECT query_id, k, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL
 JOIN b USING (query_id, k)) SELECT query_id, k, CAST(row_number() OVER (PARTITION BY query_id
 ORDER BY round(score, 12) DESC, k) AS INT) AS rank FROM f WHERE k % 5 <> 0 AND query_id IN (SELECT query_id FROM a)""")
def hybrid(spark, d):
    e = S.read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("k"), "value", "ts")
    rank = lambda x, c: x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "k"))).where("rank <= 20")
    vector = rank(e.where("query_id % 4 <> 0"), "value")
    fused = V.reciprocal_rank_fusion(vector, rank(e, "ts"), "k").select("query_id", "k", "score")
    return N.hybrid(vector, fused, e.where("k % 5 <> 0").select("k"), "k").select("query_id", "k", "rank")


@query("r03_pairwise", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0)
 SELECT a.vec_id AS a, b.vec_id AS b, greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))) AS similarity FROM e a
 JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""")
def pairwise(spark, d):
    e = S.read(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "label", V.unit(F.col("embedding")).alias("v"))
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("v").alias("w"))
    return e.join(b, "label").where("vec_id < b").select(F.col("vec_id").alias("a"), "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.dot(F.col("v"), F.col("w")))).alias("similarity"))


@query("r03_pairwise_all", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
 SELECT a.vec_id AS a, b.vec_id AS b, greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))) AS similarity FROM e a
 JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0""")
def pairwise_all(spark, d):
    """Every vector of the query set with all other vectors, whatever their labels: one request, in squares."""
    e = S.read(spark, d, "embeddings").select(F.lit(0).cast("bigint").alias("query_id"), "vec_id", V.unit(F.col("embedding")).alias("vec"))
    return V.similarities(e.where("vec_id % 50 = 0"), e).select("a", "b", "similarity")


@query("r03_candidate_matrix", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 c AS (SELECT q.vec_id AS query_id, e.vec_id, e.v FROM e, e q WHERE q.vec_id % 50 = 0
 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(0.0, least(1.0, list_cosine_similarity(q.v, e.v))) DESC, e.vec_id) <= 20)
 SELECT query_id, a.vec_id AS a, b.vec_id AS b, greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))) AS similarity
 FROM c a JOIN c b USING (query_id) WHERE a.vec_id < b.vec_id""")
def candidate_matrix(spark, d):
    """The similarities of each request's own candidates, as diversity needs them."""
    e = S.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("vec"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    c = V.vector_top_k(q, e, 20).join(e, "vec_id").select("query_id", "vec_id", "vec").checkpoint()
    return V.similarities(c, c).where("a < b")


@query("r27_marked_text", """SELECT doc_id AS document_id, string_agg('[' || k * 400 || '-' || least(length(text), (k + 1) * 400) || ']' || chr(10) ||
 substring(text, k * 400 + 1, 400), chr(10) ORDER BY k) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, CAST(greatest(1,
 ceil(length(coalesce(text, '')) / 400.0)) AS BIGINT))) AS k FROM documents) GROUP BY doc_id""")
def marked_text(spark, d):
    docs = S.read(spark, d, "documents")
    x = S.with_text(S.nodes(docs).where("height = 0"), docs)
    line = F.concat(F.lit("["), F.col("span_start"), F.lit("-"), F.col("span_end"), F.lit("]\n"), F.col("text"))
    return x.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("level_index", line.alias("t")))).alias("a")).select("document_id", F.array_join("a.t", "\n").alias("text"))
