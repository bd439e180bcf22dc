"""Queries of the core library over the driver's tables, and their SQL. Keys begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbor.functions import coords as K
from arbor.operators import inverted_index as I
from arbor.operators import repository as R
from arbor.operators import retrieval as V
from arbor.operators import telemetry as T
from arbor.operators import validation as C
from arbor.operators.metrics import positions
from arbor.plans import analytics, catalog, checks, journals, maintenance, metrics, navigation, paths, requests, stored, streams, vectors
from arbor.plans.base import NODES, ORACLES, QUERIES, REC, query, scratch, simple
from arbor.plans.base import nodes_of as _nodes
from arbor.plans.flagship import flagship
from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S

__all__ = ["ORACLES", "QUERIES", "analytics", "catalog", "checks", "journals", "maintenance", "metrics", "navigation", "paths", "requests", "stored", "streams", "vectors"]

#: Benchmark items that may go to every task.
BROADCAST_ITEMS = 10_000
COLS = ["id", "document_id", "height", "level_index", "span_start", "span_end", "token_count", "parent_id", "left_child_id", "right_child_id", "preceding_neighbor_id", "following_neighbor_id"]


simple("s03_b06_nodes", lambda n: n.select(*COLS), f"SELECT {', '.join(COLS)} FROM nodes")
simple("s01_get_node", lambda n: n.where("id = '7:0:0'").select("id", "span_end"), "SELECT id, span_end FROM nodes WHERE id = '7:0:0'")
simple("s04_paged_scan", lambda n: R.page(n, 10).groupBy("document_id", "page").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "SELECT document_id, page, count(*) AS n, min(id) AS first_id FROM (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY id) - 1) // 10 AS page FROM nodes) GROUP BY ALL")
simple("s06_s07_roots", lambda n: R.roots(n).select("id", "height", "span_start"), "SELECT id, height, span_start FROM nodes WHERE parent_id IS NULL")
simple("s08_leaves", lambda n: R.leaves(n).select("id", "token_count"), "SELECT id, token_count FROM nodes WHERE height = 0")
simple("s09_prefix_scan", lambda n: n.where(F.col("id").startswith("12:")).select("id"), "SELECT id FROM nodes WHERE starts_with(id, '12:')")
simple("s10_coordinates", lambda n: R.by_coordinates(n, n.where("height = 1").select("document_id", F.lit(0).alias("height"), F.col("level_index"))).select("id"), "SELECT id FROM nodes a WHERE height = 0 AND EXISTS (SELECT 1 FROM nodes b WHERE b.document_id = a.document_id AND b.height = 1 AND b.level_index = a.level_index)")
simple("f02_f03_span_filters", lambda n: n.where("span_end < 3000 and span_start < 2000 and span_end > 1000").select("id"), "SELECT id FROM nodes WHERE span_end < 3000 AND span_start < 2000 AND span_end > 1000")
simple("f05_overlapping", lambda n: R.overlapping(n, 500, 2100, 0, 4).select("id", "total", F.col("rank").cast("bigint").alias("rank")), """SELECT id, total, rank FROM (SELECT id, count(*) OVER (PARTITION BY document_id) AS total, row_number() OVER
 (PARTITION BY document_id ORDER BY height DESC, span_start, level_index, id) AS rank FROM nodes WHERE span_start < 2100 AND span_end > 500)
 WHERE rank <= 4""")
simple("f06_j11_leaf_at", lambda n: R.leaf_at(n, n.where("height = 1").select("document_id", F.col("span_start").alias("position")).distinct()), """SELECT DISTINCT p.document_id, p.span_start AS position, l.id FROM nodes p
 JOIN nodes l ON l.document_id = p.document_id AND l.height = 0 AND l.span_start <= p.span_start AND p.span_start < l.span_end WHERE p.height = 1""")
simple("f08_ready_left_children", lambda n: R.ready_left_children(n).select("id"), """SELECT id FROM (SELECT *, max(span_end) OVER (PARTITION BY document_id) AS e FROM nodes)
 WHERE parent_id IS NULL AND level_index % 2 = 0 AND NOT (span_start = 0 AND span_end = e) AND (preceding_neighbor_id IS NOT NULL OR span_start = 0)
 AND (following_neighbor_id IS NOT NULL OR span_end = e)""")
simple("a01_a10_document_status", R.document_status, """, a AS (SELECT document_id, count(*) AS n_nodes, count(*) FILTER (height = 0) AS n_leaves, count(*) FILTER
 (parent_id IS NULL) AS n_roots, CAST(max(height) AS BIGINT) AS height, max(span_end) AS length,
 CAST(coalesce(sum(token_count) FILTER (height = 0), 0) AS BIGINT) AS leaf_tokens, CAST(coalesce(sum(token_count) FILTER (parent_id IS NULL), 0) AS
 BIGINT) AS root_tokens, CAST(sum(span_end - span_start) FILTER (height = 0) AS BIGINT) AS leaf_chars FROM nodes GROUP BY 1)
 SELECT *, leaf_tokens // n_leaves AS avg_leaf_tokens, CASE WHEN leaf_tokens > 0 THEN leaf_chars / leaf_tokens END AS chars_per_token, 2 * n_leaves -
 bit_count(n_leaves) AS expected_nodes,
 CASE WHEN n_leaves <= 1 THEN 1.0 ELSE CAST(bit_count(n_leaves) + length(bin(n_leaves)) - 1 AS DOUBLE) / (n_roots + height) END AS completeness
 FROM a""")
simple("a06_token_stats", R.token_stats, "SELECT height, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS total, avg(token_count) AS mean, min(token_count) AS least, max(token_count) AS most FROM nodes GROUP BY height")
simple("a11_system_status", lambda n: n.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("height") == 0).alias("n_leaves"), F.max("height").cast("bigint").alias("depth")), "SELECT count(*) AS n_nodes, count(*) FILTER (height = 0) AS n_leaves, CAST(max(height) AS BIGINT) AS depth FROM nodes")
simple("a13_root_histogram", R.root_histogram, "SELECT height, count(*) AS n_roots, count(*) // 2 AS pairs FROM nodes WHERE parent_id IS NULL GROUP BY height")
simple("w01_recent_leaves", lambda n: R.recent_leaves(n, 250).select("id", "running"), """SELECT id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(token_count) OVER (PARTITION BY document_id
 ORDER BY span_end DESC, level_index DESC ROWS UNBOUNDED PRECEDING) AS running FROM nodes WHERE height = 0) WHERE running - token_count < 250""")
simple("w02_recent_leaves_upto", lambda n: R.recent_leaves(n, 150, 2000).select("id", "running"), """SELECT id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(token_count) OVER (PARTITION BY document_id
 ORDER BY span_end DESC, level_index DESC ROWS UNBOUNDED PRECEDING) AS running FROM nodes WHERE height = 0 AND span_end <= 2000)
 WHERE running - token_count < 150""")
simple("w06_suffix_by_tokens", lambda n: R.fork_budget_suffix(n, 120).select("id", "cum"), """SELECT id, CAST(cum AS BIGINT) AS cum FROM (SELECT *, sum(token_count) OVER (PARTITION BY document_id
 ORDER BY span_start DESC, level_index DESC ROWS UNBOUNDED PRECEDING) AS cum FROM nodes WHERE parent_id IS NULL) WHERE cum - token_count < 120""")
simple("t06_t07_edges", lambda n: n.groupBy("document_id").agg(F.max_by("id", F.struct("span_end", F.when(F.col("height") == 0, F.col("level_index")).otherwise(-1))).alias("last_leaf"), F.min_by(F.when(F.col("parent_id").isNull(), F.col("span_end")), F.struct(F.col("parent_id").isNotNull(), "span_start")).alias("frontier")), "SELECT document_id, max_by(id, level_index) FILTER (height = 0) AS last_leaf, min_by(span_end, span_start) FILTER (parent_id IS NULL) AS frontier FROM nodes GROUP BY 1")
simple("d02_upsert", lambda n: R.upsert(n, n.where("level_index = 1").withColumn("token_count", F.col("token_count") + 1000).withColumn("height", F.lit(99))).select("id", "height", "token_count"), "SELECT id, height, token_count + CASE WHEN level_index = 1 THEN 1000 ELSE 0 END AS token_count FROM nodes")
simple("d06_delete_by_ids", lambda n: n.join(n.where("level_index = 0").select("id"), "id", "left_anti").select("id"), "SELECT id FROM nodes WHERE level_index <> 0")
simple("d07_truncate", lambda n: R.truncate_from(n, 2000).select("id", "parent_id", "following_neighbor_id"), """, k AS (SELECT * FROM nodes WHERE span_end <= 2000) SELECT k.id, p.id AS parent_id, f.id AS
 following_neighbor_id FROM k LEFT JOIN k p ON k.parent_id = p.id LEFT JOIN k f ON k.following_neighbor_id = f.id""")
simple("j05_v08_span_union", lambda n: C.child_spans(n.withColumn("span_end", F.when(F.col("height") == 2, F.col("span_end") + 1).otherwise(F.col("span_end")))).groupBy("code").agg(F.count("*").alias("n")), """, m AS (SELECT * REPLACE (CASE WHEN height = 2 THEN span_end + 1 ELSE span_end END AS span_end)
 FROM nodes), j AS (SELECT p.span_start a, p.span_end b, l.span_start c, l.span_end d, r.span_start e, r.span_end f FROM m p
 JOIN m l ON p.left_child_id = l.id JOIN m r ON p.right_child_id = r.id) SELECT code, count(*) AS n FROM (SELECT 'span.start' AS code FROM j
 WHERE a <> c UNION ALL SELECT 'span.end' FROM j WHERE b <> f UNION ALL SELECT 'span.children' FROM j WHERE d <> e) GROUP BY code""")
simple("v02_leaf_gaps", lambda n: C.leaf_spans(n.where("not (height = 0 and level_index % 3 = 1)")), """, l AS (SELECT *, lag(span_end) OVER (PARTITION BY document_id ORDER BY span_start, level_index) AS b
 FROM nodes WHERE height = 0 AND level_index % 3 <> 1) SELECT document_id, CASE WHEN b IS NULL THEN 'leaf.span_start' ELSE 'leaf.gap' END AS code, id
 AS node_id FROM l WHERE coalesce(b, 0) <> span_start""")
simple("j01_v03_parent_links", lambda n: C.parent_links(n.where("not (height = 1 and level_index = 0)")), """, m AS (SELECT * FROM nodes WHERE NOT (height = 1 AND level_index = 0))
 SELECT c.document_id, 'parent.missing' AS code, c.id AS node_id FROM m c LEFT JOIN m p ON c.parent_id = p.id
 WHERE c.parent_id IS NOT NULL AND p.id IS NULL""")
simple("j03_v06_child_links", lambda n: C.child_links(n.where("not (height = 0 and level_index = 1)")), """, m AS (SELECT * FROM nodes WHERE NOT (height = 0 AND level_index = 1))
 SELECT p.document_id, 'child.right_missing' AS code, p.id AS node_id FROM m p LEFT JOIN m c ON p.right_child_id = c.id
 WHERE p.right_child_id IS NOT NULL AND c.id IS NULL""")
simple("j06_w04_v05_neighbors", lambda n: C.neighbors(n.where("not (height = 0 and level_index = 1)")), """, m AS (SELECT *, lag(id) OVER w AS b, lead(id) OVER w AS a FROM nodes
 WHERE NOT (height = 0 AND level_index = 1) WINDOW w AS (PARTITION BY document_id, height ORDER BY level_index))
 SELECT document_id, 'neighbor.preceding' AS code, id AS node_id FROM m WHERE preceding_neighbor_id IS DISTINCT FROM b UNION ALL
 SELECT document_id, 'neighbor.following', id FROM m WHERE following_neighbor_id IS DISTINCT FROM a""")
simple("v12_unmerged_roots", lambda n: C.coordinates(n.withColumn("parent_id", F.when(F.col("height") != 1, F.col("parent_id")))).where("code = 'forest.unmerged'"), """, m AS (SELECT * REPLACE (CASE WHEN height <> 1 THEN parent_id END AS parent_id) FROM nodes)
 SELECT a.document_id, 'forest.unmerged' AS code, a.id AS node_id FROM m a
 JOIN m b ON a.document_id = b.document_id AND a.height = b.height AND b.level_index = a.level_index + 1 AND b.parent_id IS NULL
 WHERE a.parent_id IS NULL AND a.level_index % 2 = 0""")
simple("v15_validate_all", lambda n: C.validate(n), "SELECT document_id, '' AS code, id AS node_id FROM nodes WHERE 1 = 0")


@query("c01_c08_coordinates", """SELECT id, document_id || ':' || (height + 1) || ':' || (level_index >> 1) AS parent, xor(level_index, 1) AS sibling,
 level_index << height AS first_leaf, ((level_index + 1) << height) - 1 AS last_leaf, level_index % 2 = 0 AS is_left FROM nodes""", nodes=True)
def coordinates(spark, d):
    h, li = F.col("height"), F.col("level_index")
    return _nodes(spark, d).select("id", K.node_id(F.col("document_id"), *K.parent(h, li)).alias("parent"), K.sibling(li).alias("sibling"), K.first_leaf(h, li).alias("first_leaf"), K.last_leaf(h, li).alias("last_leaf"), K.is_left(li).alias("is_left"))


def _seeds(n):
    return n.where("height = 0 and level_index % 5 = 3").select(F.col("document_id").alias("query_id"), "document_id", "height", "level_index")


@query("r10_coverage", """, top AS (SELECT document_id, max(height) AS t FROM nodes GROUP BY 1), sd AS (SELECT n.document_id, level_index,
 unnest(range(0, t + 1)) AS h FROM nodes n JOIN top USING (document_id) WHERE height = 0 AND level_index % 5 = 3),
 c AS (SELECT document_id, h AS height, level_index >> h AS level_index FROM sd UNION SELECT document_id, h, xor(level_index >> h, 1) FROM sd
 UNION SELECT document_id, height, level_index FROM nodes WHERE parent_id IS NULL AND document_id IN (SELECT document_id FROM sd))
 SELECT c.document_id AS query_id, n.id FROM c JOIN nodes n USING (document_id, height, level_index)""", nodes=True)
def coverage(spark, d):
    n = _nodes(spark, d)
    return V.coverage(_seeds(n), n).select("query_id", "id")


@query("st08_sessions", """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n
 FROM (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id
 ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    from arbor.streaming.journal import sessions

    x = sessions(S.read(spark, d, "events"))
    return x.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _all_leaves(n):
    return n.where("height = 0").select(F.col("document_id").alias("query_id"), "document_id", "height", "level_index")


@query("r10_coverage_all_leaves", " SELECT DISTINCT document_id AS query_id, id FROM nodes", nodes=True)
def coverage_all_leaves(spark, d):
    """Seeds are all leaves, so documents of one to three leaves have rows too."""
    n = _nodes(spark, d)
    return V.coverage(_all_leaves(n), n).select("query_id", "id")


@query("r17_r19_frontier_all_leaves", " SELECT DISTINCT document_id AS query_id, id, span_start, span_end FROM nodes WHERE height = 0", nodes=True)
def frontier_all_leaves(spark, d):
    n = _nodes(spark, d)
    return V.frontier(V.coverage(_all_leaves(n), n)).select("query_id", "id", "span_start", "span_end")


@query(
    "r17_r19_frontier",
    """, top AS (SELECT document_id, max(height) AS t FROM nodes GROUP BY 1), sd AS (SELECT n.document_id, level_index, unnest(range(0, t + 1)) AS h
 FROM nodes n JOIN top USING (document_id) WHERE height = 0 AND level_index % 5 = 3),
 c AS (SELECT document_id, h AS height, level_index >> h AS level_index FROM sd UNION SELECT document_id, h, xor(level_index >> h, 1) FROM sd
 UNION SELECT document_id, height, level_index FROM nodes WHERE parent_id IS NULL AND document_id IN (SELECT document_id FROM sd)),
 v AS (SELECT n.* FROM c JOIN nodes n USING (document_id, height, level_index))
 SELECT document_id AS query_id, id, span_start, span_end FROM v WHERE id NOT IN (SELECT parent_id FROM v WHERE parent_id IS NOT NULL)""",
    nodes=True,
)
def frontier(spark, d):
    n = _nodes(spark, d)
    return V.frontier(V.coverage(_seeds(n), n)).select("query_id", "id", "span_start", "span_end")


@query("v16_tiling_covers", "SELECT doc_id AS document_id, true AS covers FROM documents WHERE length(text) > 0 AND ceil(length(text) / 400.0) >= 4")
def tiling_covers(spark, d):
    n = _nodes(spark, d)
    front = V.frontier(V.coverage(_seeds(n), n))
    lengths = S.sizes(S.read(spark, d, "documents")).where("n_leaves >= 4").select("document_id", "len")
    return C.tiling_report(front, lengths, 10**9).select("document_id", "covers")


@query("v16_tiling_covers_all_leaves", "SELECT doc_id AS document_id, true AS covers FROM documents WHERE length(text) > 0")
def tiling_covers_all_leaves(spark, d):
    n = _nodes(spark, d)
    front = V.frontier(V.coverage(_all_leaves(n), n))
    lengths = S.sizes(S.read(spark, d, "documents")).where("len > 0").select("document_id", "len")
    return C.tiling_report(front, lengths, 10**9).select("document_id", "covers")


def _vectors(spark, d):
    e = S.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("vec"), "label")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")


@query("t01_r02_vector_top_k", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id,
 e.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(q.v, e.v))) AS relevance FROM e, e q WHERE q.vec_id % 50 = 0)
 SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM s)
 WHERE rank <= 5""")
def vector_top_k(spark, d):
    e, q = _vectors(spark, d)
    return V.vector_top_k(q, e, 5).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def _mmr_sql(k: int) -> str:
    """Each step takes the candidate with the best balance against all that were taken before."""
    cos = "greatest(0.0, least(1.0, list_cosine_similarity({}.v, {}.v)))"
    steps = "".join(f""",
 g{t} AS (SELECT c.query_id, c.vec_id, c.rank, any_value(c.rel) AS rel, max({cos.format("c", "m")}) AS near FROM c JOIN m{t - 1} m USING (query_id)
 WHERE NOT EXISTS (SELECT 1 FROM m{t - 1} x WHERE x.query_id = c.query_id AND x.vec_id = c.vec_id) GROUP BY ALL),
 n{t} AS (SELECT * FROM g{t} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.7::DOUBLE * rel - 0.3::DOUBLE * near DESC, rank) = 1),
 m{t} AS (SELECT * FROM m{t - 1} UNION ALL SELECT query_id, vec_id, v, {t} FROM n{t} JOIN e USING (vec_id))""" for t in range(2, k + 1))
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 c AS (SELECT q.vec_id AS query_id, e.vec_id, e.v, {cos.format("q", "e")} AS rel, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY {cos.format("q", "e")} DESC, e.vec_id) AS rank FROM e, e q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20),
 m1 AS (SELECT query_id, vec_id, v, 1 AS position FROM c WHERE rank = 1){steps} SELECT query_id, vec_id, position FROM m{k}"""


@query("r07_mmr", _mmr_sql(5))
def mmr(spark, d):
    e, q = _vectors(spark, d)
    return V.mmr(V.vector_top_k(q, e, 20).join(e.select("vec_id", "vec"), "vec_id"), 5)


#: Scores of all texts of d (doc_id, t) for all items.
_SCORES = """st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
 p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term
 FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf
 JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)"""
_BM25 = (
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t
 FROM documents), """
    + _SCORES
    + """
 SELECT query_id, doc_id AS doc_key, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id
 ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""
)


_OKAPI = r"""{nodes}, tx AS (SELECT n.document_id, n.id, n.height, n.level_index, regexp_extract_all(lower(substring(coalesce(text, ''), span_start + 1,
 CASE WHEN height = 0 THEN span_end - span_start ELSE token_count * 4 END)), '[\p{L}\p{N}_]+') AS t FROM nodes n
 JOIN documents ON doc_id = document_id),
 qq AS (SELECT doc_id AS document_id, unnest(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+')) AS term FROM documents
 JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS m FROM benchmark) b ON doc_id % m = k),
 q AS (SELECT document_id, term, count(*) AS times FROM qq GROUP BY ALL), st AS (SELECT document_id, count(*) AS n, avg(len(t)) AS a FROM tx
 GROUP BY 1),
 tf AS (SELECT document_id, id, term, count(*) AS tf FROM (SELECT document_id, id, unnest(t) AS term FROM tx)
 GROUP BY ALL), df AS (SELECT document_id, term, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (document_id)
 GROUP BY ALL),
 mean AS (SELECT document_id, avg(raw) AS mean FROM df GROUP BY 1), sc AS (SELECT tx.document_id, tx.id, sum(times * CASE WHEN raw < 0 THEN 0.25 *
 mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / a))) AS score FROM tf JOIN q USING (document_id, term)
 JOIN df USING (document_id, term) JOIN mean USING (document_id) JOIN st USING (document_id) JOIN tx ON tx.id = tf.id GROUP BY ALL)
 SELECT document_id AS query_id, id AS doc_key, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY document_id
 ORDER BY round(coalesce(score, 0), 9) DESC, height, level_index) AS rank FROM tx LEFT JOIN sc USING (document_id, id) QUALIFY rank <= 5"""


@query("r04_t04_bm25", _BM25)
def bm25(spark, d):
    """Every benchmark item, over a stored index of the documents."""
    ensure_checkpoint_dir(spark)
    folder = scratch(spark, "bm25")
    I.build_index(S.read(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text"), folder)
    asked = S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return I.top_k(folder, asked, 10).select("query_id", "doc_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("t04_scored_rows", """SELECT count(*) * (SELECT count(*) FROM documents) AS pairs, true AS few FROM benchmark""")
def scored_rows(spark, d):
    """Of the pairs of items and leaves of documents, few (a quarter at most) are scored; pairs are told in documents, which SQL can count."""
    ensure_checkpoint_dir(spark)
    docs, folder = S.read(spark, d, "documents"), scratch(spark, "bm25")
    leaves = S.leaf_texts(docs).withColumnRenamed("id", "doc_key")
    I.build_index(leaves, folder)
    asked = S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    scored = I.search(folder, asked, 20).agg(F.sum("scored").alias("scored"))
    counts = asked.agg(F.count("*").alias("items")).join(docs.agg(F.count("*").alias("docs"))).join(leaves.agg(F.count("*").alias("leaves"))).join(scored)  # four single rows
    return counts.select((F.col("items") * F.col("docs")).alias("pairs"), (F.col("scored") * 4 <= F.col("items") * F.col("leaves")).alias("few"))


@query(
    "r04_okapi_nodes",
    _OKAPI.replace("{nodes}", NODES),
)
def okapi(spark, d):
    """Every document is asked one benchmark question, over all its nodes, summaries included."""
    ensure_checkpoint_dir(spark)
    docs = S.read(spark, d, "documents")
    n = S.with_text(S.nodes(docs), docs)
    order = F.struct("height", "level_index")
    asked = S.read(spark, d, "benchmark")
    placed = asked.join(positions(asked, [], "item_id").select("item_id", (F.col("upto") - 1).alias("k")), "item_id").select("k", "text").checkpoint()
    m = placed.count()
    if m <= BROADCAST_ITEMS:
        placed = F.broadcast(placed)
    q = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % m if m else F.lit(None)).cast("bigint").alias("k")).join(placed, "k")
    q = q.select(F.col("document_id").alias("query_id"), "document_id", F.col("text").alias("query_text"))
    return V.okapi(n.select("document_id", F.col("id").alias("doc_key"), order.alias("position"), "text"), q, 5).select("query_id", "doc_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("r05_rrf", """WITH a AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY user_id
 ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 20), b AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY
 user_id ORDER BY ts DESC, event_id) AS r FROM events QUALIFY r <= 20)
 SELECT query_id, k, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (query_id, k)""")
def rrf(spark, d):
    e = S.read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("k"), "value", "ts")
    rank = lambda c: e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "k"))).where("rank <= 20")
    return V.reciprocal_rank_fusion(rank("value"), rank("ts"), "k").drop("rank")


@query("r18_flagship_tiling")
def tiling(spark, d):
    return flagship(spark, d)


@query(
    "r18_no_budget",
    NODES + r""", d AS (SELECT n.id AS doc_id, regexp_extract_all(lower(substring(coalesce(text, ''), span_start + 1, span_end - span_start)),
 '[\p{L}\p{N}_]+') AS t FROM nodes n JOIN documents ON doc_id = document_id WHERE height = 0), """ + _SCORES.replace(" s AS (", " sc AS (") + """,
 sd AS (SELECT query_id, n.document_id, n.level_index FROM (SELECT query_id, doc_id AS id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id
 ORDER BY round(score, 9) DESC, doc_id) <= 20) JOIN nodes n USING (id)),
 up AS (SELECT query_id, document_id, level_index, unnest(range(0, t + 1)) AS h FROM sd JOIN (SELECT document_id, max(height) AS t FROM nodes
 GROUP BY 1) USING (document_id)),
 c AS (SELECT query_id, document_id, h AS height, level_index >> h AS level_index FROM up UNION SELECT query_id, document_id, h,
 xor(level_index >> h, 1) FROM up UNION SELECT query_id, document_id, height, level_index FROM nodes JOIN (SELECT DISTINCT query_id, document_id
 FROM sd) USING (document_id) WHERE parent_id IS NULL),
 v AS (SELECT query_id, n.* FROM c JOIN nodes n USING (document_id, height, level_index)),
 f AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v k WHERE k.query_id = v.query_id AND k.parent_id = v.id)),
 a AS (SELECT query_id, document_id, level_index FROM sd UNION SELECT query_id, document_id, xor(level_index, 1) FROM sd)
 SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id, f.document_id ORDER BY span_start, f.id) - 1 AS position,
 round(CASE WHEN height > 0 THEN 0.0 WHEN a.query_id IS NOT NULL THEN coalesce(sc.score / (sc.score + 10), 0.0) END, 6) AS score
 FROM f LEFT JOIN a ON a.query_id = f.query_id AND a.document_id = f.document_id AND a.level_index = f.level_index AND f.height = 0
 LEFT JOIN sc ON sc.query_id = f.query_id AND sc.doc_id = f.id""",
)
def tiling_no_budget(spark, d):
    """The flagship without a budget: each tiling is the whole frontier, with its scores."""
    return flagship(spark, d, budget=None).select("query_id", "id", "position", F.round("score", 6).alias("score"))


@query("r21_assembly", """SELECT doc_id AS query_id, doc_id AS document_id, string_agg(c, chr(10) || chr(10) ORDER BY k) AS text
 FROM (SELECT doc_id, k, substring(text, k * 400 + 1, 400) AS c FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil(length(text) / 400.0)) AS
 BIGINT))) AS k FROM documents)) WHERE c <> '' GROUP BY doc_id""")
def assembly(spark, d):
    docs = S.read(spark, d, "documents")
    leaves = S.leaf_texts(docs)
    return V.assemble(leaves.select(F.col("document_id").alias("query_id"), "document_id", F.col("level_index").alias("position"), "text"))


@query("b06_b08_units", """SELECT conv_id AS document_id, row_number() OVER w - 1 AS level_index, CAST(sum(length(text)) OVER w - length(text) AS
 BIGINT) AS span_start, CAST(sum(length(text)) OVER w AS BIGINT) AS span_end, CAST(turn * 60 AS DOUBLE) AS time_start
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def units(spark, d):
    return S.units(S.read(spark, d, "conversations")).select("document_id", "level_index", "span_start", "span_end", "time_start")


@query("j12_time_to_leaf", """WITH u AS (SELECT conv_id AS document_id, row_number() OVER (PARTITION BY conv_id
 ORDER BY turn) - 1 AS li, turn * 60.0 AS t0 FROM conversations), t AS (SELECT DISTINCT conv_id AS document_id, CAST(x AS DOUBLE) AS t
 FROM conversations, (VALUES (90.0), (180.0)) v(x)) SELECT t.document_id, t.t, min_by(li, t0) FILTER (t0 >= t.t) AS first_leaf, max_by(li, t0) FILTER
 (t0 <= t.t) AS last_leaf FROM t JOIN u USING (document_id) GROUP BY 1, 2""")
def time_to_leaf(spark, d):
    u = S.units(S.read(spark, d, "conversations"))
    times = u.select("document_id").distinct().withColumn("t", F.explode(F.array(F.lit(90.0), F.lit(180.0))))
    return V.time_to_leaf(u, times)


@query("m03_m07_robust_stats", """WITH a AS (SELECT event_type, count(value) AS n, avg(value) AS mean, median(value) AS median, quantile_cont(value,
 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, coalesce(stddev_samp(value), 0) AS std, stddev_pop(value) AS
 pstd FROM events GROUP BY 1) SELECT a.*, p75 - p25 AS iqr, (SELECT median(abs(e.value - a.median)) FROM events e
 WHERE e.event_type = a.event_type) AS mad FROM a""")
def robust(spark, d):
    return T.robust_stats(S.read(spark, d, "events"), ["event_type"], "value")


@query("a21_quantile_exclusive", """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type
 ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events
 WHERE value IS NOT NULL), p AS (SELECT *, greatest(1.0, least(n, 0.9 * (n + 1))) AS pos FROM x)
 SELECT event_type, max(value) FILTER (i = floor(pos)) + (max(value) FILTER (i = ceil(pos)) - max(value) FILTER (i = floor(pos))) * max(pos -
 floor(pos)) AS quantile FROM p GROUP BY 1""")
def exclusive(spark, d):
    return T.quantile_exclusive(S.read(spark, d, "events"), ["event_type"], "value", 0.9)


@query("m14_quantile_nearest", """SELECT event_type, value AS quantile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type
 ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(n - 1, floor(n * 0.95))""")
def nearest(spark, d):
    return T.quantile_nearest(S.read(spark, d, "events"), ["event_type"], "value", 0.95)


@query("m20_token_f1", None)
def f1(spark, d):
    c = S.read(spark, d, "conversations")
    a, b = (c.where(f"turn = {k}").select("conv_id", F.col("text").alias(f"t{k}")) for k in (0, 2))
    return T.token_f1(a.join(b, "conv_id"), "t0", "t2", "conv_id")


@query("st04_m24_journal_fold", """WITH j AS (SELECT event_id, user_id AS append_id, ts, CASE event_id % 4 WHEN 0 THEN 'append_started' WHEN 1 THEN
 'node_committed' WHEN 2 THEN 'append_completed' ELSE 'append_failed' END AS event FROM events)
 SELECT append_id, arg_min(event_id, (ts, event_id)) FILTER (event = 'append_started') AS first_start, arg_max(event_id, (ts, event_id)) FILTER
 (event IN ('append_completed', 'append_failed')) AS last_end, coalesce(arg_max(event, (ts, event_id)) FILTER (event IN ('append_completed',
 'append_failed')), 'running') AS outcome, count(*) FILTER (event = 'node_committed') AS commits, count(*) AS n FROM j GROUP BY 1""")
def journal_fold(spark, d):
    return T.fold_journal(S.journal(S.read(spark, d, "events")))


@query("st04_journal_stream", "SELECT user_id AS append_id, count(*) AS n, count(*) FILTER (event_id % 4 = 1) AS commits, max(event_id) AS last_event FROM events GROUP BY 1")
def journal_stream(spark, d):
    """Each batch writes the keys that it touches and no others."""
    from arbor.streaming.journal import fold_stream, stream_events
    from arbor.streaming.stateful import latest, run_changes

    return latest(run_changes(fold_stream(stream_events(spark, d)), scratch(spark, "journal"), "update"), "append_id", "n").select("append_id", "n", "commits", "last_event")


@query("g01_bridge", REC + "SELECT session, uuid, coalesce(parent, prev) AS parent FROM r")
def bridge(spark, d):
    return T.bridge(S.transcript(S.read(spark, d, "events"))).select("session", "uuid", "parent")


@query("g06_head", REC + "SELECT session, max_by(uuid, line) AS head FROM r GROUP BY 1")
def head(spark, d):
    return T.head(S.transcript(S.read(spark, d, "events")))


@query("g02_ancestry_chain", REC.replace("WITH r", "WITH RECURSIVE r") + """, b AS (SELECT session, uuid, coalesce(parent, prev) AS parent, line
 FROM r), c AS (SELECT session, max_by(uuid, line) AS uuid, 0 AS depth FROM b GROUP BY 1 UNION ALL SELECT b.session, b.parent, depth + 1 FROM c
 JOIN b ON b.session = c.session AND b.uuid = c.uuid WHERE b.parent IS NOT NULL) SELECT session, uuid, CAST(depth AS BIGINT) AS depth FROM c""")
def ancestry(spark, d):
    return T.chain(T.bridge(S.transcript(S.read(spark, d, "events"))))


@query("g09_turns", REC + """, t AS (SELECT *, sum(is_user::INT) OVER (PARTITION BY session ORDER BY line ROWS UNBOUNDED PRECEDING) AS turn
 FROM r) SELECT session, CAST(turn AS BIGINT) AS turn, count(*) AS n, min_by(uuid, line) AS first_uuid, max_by(uuid, line) AS last_uuid FROM t
 WHERE turn > 0 GROUP BY 1, 2""")
def turns(spark, d):
    return T.turns(S.transcript(S.read(spark, d, "events")))


@query("b19_m06_cost", """WITH t AS (SELECT conv_id, sum(length(text) // 4)::DOUBLE AS p, sum(length(text) // 40)::DOUBLE AS c, sum(length(text) //
 8)::DOUBLE AS q FROM conversations GROUP BY 1) SELECT conv_id, ((p - c) * 0.4::DOUBLE + c * 0.1::DOUBLE + q * 1.6::DOUBLE) / 1000000 AS cost FROM t""")
def costs(spark, d):
    n = F.length("text")
    t = S.read(spark, d, "conversations").groupBy("conv_id").agg(*[F.sum(F.floor(n / k)).alias(f"n{k}") for k in (4, 40, 8)])
    return t.select("conv_id", T.cost(F.col("n4"), F.col("n40"), F.col("n8"), 0.4, 0.1, 1.6).alias("cost"))
