"""Queries of the validators over trees with breaks of every kind, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import validation as C
from arbor.plans.base import query, simple
from arbor.sources import corpus as S


def broken(n):
    """One break in each document, by its id modulo 12; kinds 0 and 11 stay whole."""
    k, h, li = F.col("document_id") % 12, F.col("height"), F.col("level_index")
    here = lambda kind, height, index: (k == kind) & (h == height) & (li == index)
    x = n.where(~here(3, 1, 0) & ~here(5, 0, 0) & ~here(6, 0, 1))
    x = x.withColumn("span_start", F.when(here(1, 0, 0) | here(2, 0, 2), F.col("span_start") + 1).otherwise(F.col("span_start")))
    x = x.withColumn("span_end", F.when(here(7, 1, 0), F.col("span_end") + 1).otherwise(F.col("span_end")))
    x = x.withColumn("left_child_id", F.when(~here(4, 1, 0), F.col("left_child_id")))
    x = x.withColumn("parent_id", F.when(~((k == 8) & (h == 0)), F.col("parent_id")))
    x = x.withColumn("preceding_neighbor_id", F.when(here(9, 0, 1), F.col("id")).otherwise(F.col("preceding_neighbor_id")))
    moved = here(10, 0, 1)
    return x.withColumn("level_index", F.when(moved, 0).otherwise(li)).withColumn("height", F.when((k == 10) & (h == 1) & (li == 1), 3).otherwise(h))


_BROKEN = """, b0 AS (SELECT *, document_id % 12 AS k FROM nodes),
 m AS (SELECT id, document_id, CASE WHEN k = 10 AND height = 1 AND level_index = 1 THEN 3 ELSE height END AS height, CASE WHEN k = 10 AND height = 0
 AND level_index = 1 THEN 0 ELSE level_index END AS level_index,
  CASE WHEN (k = 1 AND height = 0 AND level_index = 0) OR (k = 2 AND height = 0 AND level_index = 2) THEN span_start + 1 ELSE span_start END AS
 span_start,
  CASE WHEN k = 7 AND height = 1 AND level_index = 0 THEN span_end + 1 ELSE span_end END AS span_end, token_count, CASE WHEN NOT (k = 8 AND height =
 0) THEN parent_id END AS parent_id,
  CASE WHEN NOT (k = 4 AND height = 1 AND level_index = 0) THEN left_child_id END AS left_child_id, right_child_id,
  CASE WHEN k = 9 AND height = 0 AND level_index = 1 THEN id ELSE preceding_neighbor_id END AS preceding_neighbor_id, following_neighbor_id
  FROM b0 WHERE NOT (k = 3 AND height = 1 AND level_index = 0) AND NOT (k = 5 AND height = 0 AND level_index = 0) AND NOT (k = 6 AND height = 0 AND
 level_index = 1))"""
_PAIR = "m p JOIN m l ON p.left_child_id = l.id JOIN m r ON p.right_child_id = r.id"
_FINDINGS = f"""{_BROKEN}, lf AS (SELECT *, lag(span_end) OVER (PARTITION BY document_id ORDER BY span_start, level_index) AS b FROM m WHERE height = 0),
 nb AS (SELECT *, lag(id) OVER w AS bi, lead(id) OVER w AS ai FROM m WINDOW w AS (PARTITION BY document_id, height ORDER BY level_index)),
 f AS (SELECT document_id, 'leaf.span_start' AS code FROM lf WHERE b IS NULL AND span_start <> 0 UNION ALL SELECT document_id, 'leaf.gap' FROM lf WHERE b <> span_start
 UNION ALL SELECT document_id, 'parent.missing' FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM m)
 UNION ALL SELECT c.document_id, 'parent.disclaims' FROM m c JOIN m p ON c.parent_id = p.id WHERE p.left_child_id IS DISTINCT FROM c.id AND p.right_child_id IS DISTINCT FROM c.id
 UNION ALL SELECT document_id, 'tree.one_child' FROM m WHERE (left_child_id IS NULL) <> (right_child_id IS NULL)
 UNION ALL SELECT document_id, 'child.left_missing' FROM m WHERE left_child_id IS NOT NULL AND left_child_id NOT IN (SELECT id FROM m)
 UNION ALL SELECT document_id, 'child.right_missing' FROM m WHERE right_child_id IS NOT NULL AND right_child_id NOT IN (SELECT id FROM m)
 UNION ALL SELECT p.document_id, 'span.start' FROM {_PAIR} WHERE p.span_start <> l.span_start UNION ALL SELECT p.document_id, 'span.end' FROM {_PAIR} WHERE p.span_end <> r.span_end
 UNION ALL SELECT p.document_id, 'span.children' FROM {_PAIR} WHERE l.span_end <> r.span_start
 UNION ALL SELECT p.document_id, 'coord.height' FROM {_PAIR} WHERE p.height <> l.height + 1 OR p.height <> r.height + 1
 UNION ALL SELECT p.document_id, 'coord.index' FROM {_PAIR} WHERE l.level_index <> p.level_index * 2 OR r.level_index <> p.level_index * 2 + 1
 UNION ALL SELECT document_id, 'neighbor.preceding' FROM nb WHERE document_id % 12 <> 10 AND preceding_neighbor_id IS DISTINCT FROM bi UNION ALL SELECT document_id, 'neighbor.following' FROM nb WHERE document_id % 12 <> 10 AND following_neighbor_id IS DISTINCT FROM ai
 UNION ALL SELECT document_id, 'coord.duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY document_id, height, level_index) AS n FROM m) WHERE n > 1
 UNION ALL SELECT a.document_id, 'forest.unmerged' FROM m a JOIN m b ON a.document_id = b.document_id AND a.height = b.height AND b.level_index = a.level_index + 1 AND b.parent_id IS NULL WHERE a.parent_id IS NULL AND a.level_index % 2 = 0)"""


def _counts(findings):
    """Findings by document and code; neighbours around the place that two nodes claim depend on their order and are left out."""
    return findings.where("not (document_id % 12 = 10 and startswith(code, 'neighbor.'))").groupBy("document_id", "code").agg(F.count("*").alias("n"))


simple("v15_v22_every_code", lambda n: _counts(C.validate(broken(n))), f"{_FINDINGS} SELECT document_id, code, count(*) AS n FROM f GROUP BY ALL")
simple("v03_parent_links", lambda n: _counts(C.parent_links(broken(n))), f"{_FINDINGS} SELECT document_id, code, count(*) AS n FROM f WHERE code LIKE 'parent.%' GROUP BY ALL")
simple(
    "v07_node_coordinates",
    lambda n: C.node_coordinates(broken(n)).groupBy("document_id", "code").agg(F.count("*").alias("n")),
    f"""{_BROKEN}, xx AS (SELECT p.*, l.height AS lh, l.level_index AS li, r.height AS rh, r.level_index AS ri FROM m p LEFT JOIN m l ON p.left_child_id = l.id LEFT JOIN m r ON p.right_child_id = r.id), f AS (
 SELECT document_id, 'coord.leaf_height' AS code FROM xx WHERE left_child_id IS NULL AND right_child_id IS NULL AND height <> 0 UNION ALL SELECT document_id, 'coord.height_mismatch' FROM xx WHERE height <> lh + 1 OR height <> rh + 1
 UNION ALL SELECT document_id, 'coord.level_index_mismatch' FROM xx WHERE level_index <> li // 2 UNION ALL SELECT document_id, 'coord.left_child_odd' FROM xx WHERE li % 2 <> 0
 UNION ALL SELECT document_id, 'coord.right_child_even' FROM xx WHERE ri % 2 <> 1 UNION ALL SELECT document_id, 'coord.sibling_index' FROM xx WHERE ri <> li + 1)
 SELECT document_id, code, count(*) AS n FROM f GROUP BY ALL""",
)


@query("v01_empty_trees", "SELECT doc_id AS document_id, 'tree.empty' AS code FROM documents WHERE doc_id % 6 = 0")
def empty_trees(spark, d):
    docs = S.read(spark, d, "documents")
    return C.empty_trees(docs.select(F.col("doc_id").alias("document_id")), S.nodes(docs.where("doc_id % 6 <> 0"))).select("document_id", "code")


simple(
    "v12_leaf_completeness",
    lambda n: C.leaf_completeness(n.where("height = 0").withColumn("embedding", F.when(F.col("level_index") % 5 != 2, F.array(F.lit(1.0)))).withColumn("preceding_context", F.when(F.col("level_index") % 7 != 0, F.lit("[]")))).select("code", "node_id"),
    """SELECT 'forest.no_embedding' AS code, id AS node_id FROM nodes WHERE height = 0 AND level_index % 5 = 2 UNION ALL
 SELECT 'forest.no_context', id FROM nodes WHERE height = 0 AND level_index % 7 = 0 AND level_index > 0""",
)


def _telemetry(n):
    """Entries of every node but some, with ids, heights and spans broken by the index of the node."""
    li = F.col("level_index")
    span = F.when(li % 13 == 3, "x").when(li % 13 == 5, F.concat_ws(",", F.col("span_start") + 1, "span_end")).otherwise(F.concat_ws(",", "span_start", "span_end"))
    height = F.when(li % 11 == 4, None).when(li % 11 == 6, "high").when(li % 11 == 8, (F.col("height") + 2).cast("string")).otherwise(F.col("height").cast("string"))
    t = n.where("level_index % 9 <> 7").select("document_id", F.lit(1).alias("entry"), F.when(li % 17 == 9, "").when(li % 17 == 11, F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("node_id"), height.alias("height"), span.alias("span"))
    return t.unionByName(n.where("level_index = 1").select("document_id", F.lit(2).alias("entry"), F.col("id").alias("node_id"), F.lit("0").alias("height"), F.lit(None).cast("string").alias("span")))


simple(
    "v14_j15_telemetry",
    lambda n: C.telemetry_findings(n, _telemetry(n)).groupBy("document_id", "code").agg(F.count("*").alias("n")),
    """, t AS (SELECT document_id, id, height AS h, span_start AS a, span_end AS b, level_index AS li FROM nodes
 WHERE level_index % 9 <> 7), g AS (SELECT * FROM t WHERE li % 17 NOT IN (9, 11)), f AS (
 SELECT document_id, 'telemetry.node.missing_id' AS code FROM t WHERE li % 17 = 9 UNION ALL SELECT document_id, 'telemetry.node.duplicate'
 FROM nodes WHERE level_index = 1
 UNION ALL SELECT document_id, 'telemetry.node.missing' FROM nodes WHERE id NOT IN (SELECT id FROM g) UNION ALL
 SELECT document_id, 'telemetry.node.unexpected' FROM t WHERE li % 17 = 11
 UNION ALL SELECT document_id, 'telemetry.missing.height' FROM g WHERE li % 11 = 4 UNION ALL SELECT document_id, 'telemetry.invalid.height'
 FROM g WHERE li % 11 = 6 UNION ALL SELECT document_id, 'telemetry.mismatch.height' FROM g WHERE li % 11 = 8
 UNION ALL SELECT document_id, 'telemetry.invalid.span' FROM g WHERE li % 13 = 3 UNION ALL SELECT document_id, 'telemetry.mismatch.span' FROM g
 WHERE li % 13 = 5)
 SELECT document_id, code, count(*) AS n FROM f GROUP BY ALL""",
)
simple(
    "v15_report",
    lambda n: C.report(broken(n).withColumn("token_count", F.when((F.col("height") == 2) & (F.col("document_id") % 5 == 0), 0).otherwise(F.col("token_count"))), C.validate(broken(n)), n.where("height = 0 and document_id % 7 <> 0").select("id")).select("document_id", "n_nodes", "pending_embeddings", "pending_summaries", "mergeable_pairs", "status"),
    f"""{_FINDINGS}, z AS (SELECT * REPLACE (CASE WHEN height = 2 AND document_id % 5 = 0 THEN 0 ELSE token_count END AS token_count) FROM m), a AS (SELECT document_id, count(*) AS n_nodes, count(*) FILTER (height = 0 AND (document_id % 7 = 0 OR id NOT IN (SELECT id FROM nodes WHERE height = 0))) AS pending_embeddings, count(*) FILTER (height > 0 AND token_count = 0 AND span_end > span_start) AS pending_summaries FROM z GROUP BY 1),
 p AS (SELECT document_id, CAST(sum(c // 2) AS BIGINT) AS mergeable_pairs FROM (SELECT document_id, height, count(*) AS c FROM m WHERE parent_id IS NULL GROUP BY ALL) GROUP BY 1)
 SELECT a.*, coalesce(mergeable_pairs, 0) AS mergeable_pairs, CASE WHEN document_id IN (SELECT document_id FROM f) THEN 'invalid' WHEN pending_embeddings + pending_summaries + coalesce(mergeable_pairs, 0) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM a LEFT JOIN p USING (document_id)""",
)
simple(
    "v18_chunk_report",
    lambda n: C.chunk_report(n.where("height = 0").withColumn("token_count", F.col("token_count") + F.col("level_index") % 3 * 15 - F.col("level_index") % 5 * 9), 100),
    """, l AS (SELECT document_id, level_index, token_count + level_index % 3 * 15 - level_index % 5 * 9 AS t, max(level_index) OVER (PARTITION BY
 document_id) AS last FROM nodes WHERE height = 0) SELECT document_id, count(*) AS n_leaves, count(*) FILTER (t > 120) AS oversized, count(*) FILTER
 (t < 80 AND level_index <> last) AS undersized FROM l GROUP BY 1""",
)
simple("v20_uneven_trees", lambda n: C.uneven_trees(n.where("not (height = 0 and level_index = 2)")).select("node_id"), "SELECT id AS node_id FROM nodes WHERE parent_id IS NULL AND height > 0 AND 2 >= level_index << height AND 2 < (level_index + 1) << height")


@query("v17_text_coverage", """, l AS (SELECT *, lead(span_start) OVER (PARTITION BY document_id ORDER BY span_start, level_index) AS nxt
 FROM nodes WHERE height = 0 AND NOT (document_id % 5 = 1 AND level_index = 0) AND NOT (document_id % 5 = 2 AND level_index = 2)), a AS (SELECT
 document_id, min(span_start) AS lo, max_by(span_end, (span_start, level_index)) AS hi, count(*) FILTER (nxt <> span_end) AS gaps FROM l
 GROUP BY 1) SELECT doc_id AS document_id, CASE WHEN lo IS NULL THEN 'no_leaves' WHEN lo <> 0 THEN 'start' WHEN hi <> length(coalesce(text, '')) +
 CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END THEN 'end' WHEN gaps > 0 THEN 'gap' END AS error FROM documents LEFT JOIN a ON document_id = doc_id""", nodes=True)
def text_coverage(spark, d):
    docs = S.read(spark, d, "documents")
    leaves = S.nodes(docs).where("height = 0 and not (document_id % 5 = 1 and level_index = 0) and not (document_id % 5 = 2 and level_index = 2)")
    return C.text_coverage(leaves, S.sizes(docs).withColumn("len", F.col("len") + F.when(F.col("document_id") % 5 == 3, 1).otherwise(0)))


@query(
    "v19_structure",
    """, m AS (SELECT * REPLACE (CASE WHEN height = 0 AND level_index % 2 = 1 AND document_id % 3 = 0 THEN span_start + 1 WHEN height = 0 AND
 level_index = 0 AND document_id % 3 = 1 THEN span_start + 2 ELSE span_start END AS span_start) FROM nodes
 WHERE NOT (height = 0 AND level_index = 3 AND document_id % 3 = 2)),
 xx AS (SELECT p.*, l.id AS lid, r.id AS rid, l.span_start AS ls, l.span_end AS le, r.span_start AS rs, r.span_end AS re FROM m p LEFT
 JOIN m l ON p.left_child_id = l.id LEFT JOIN m r ON p.right_child_id = r.id), f AS (
 SELECT id, 'span.empty' AS code FROM xx WHERE span_start >= span_end UNION ALL SELECT id, 'child.left_missing' FROM xx
 WHERE left_child_id IS NOT NULL AND lid IS NULL UNION ALL SELECT id, 'child.right_missing' FROM xx WHERE right_child_id IS NOT NULL AND rid IS NULL
 UNION ALL SELECT id, 'span.start' FROM xx WHERE ls <> span_start UNION ALL SELECT id, 'span.end' FROM xx WHERE re <> span_end
 UNION ALL SELECT id, 'span.gap' FROM xx JOIN documents ON doc_id = document_id
 WHERE le < rs AND regexp_matches(substring(text, le + 1, rs - le), '[^ \\t\\n\\x0B\\f\\r]'))
 SELECT id AS node_id, code FROM f""",
    nodes=True,
)
def structure(spark, d):
    docs = S.read(spark, d, "documents")
    h, li, k = F.col("height"), F.col("level_index"), F.col("document_id") % 3
    n = S.nodes(docs).where("not (height = 0 and level_index = 3 and document_id % 3 = 2)")
    n = n.withColumn("span_start", F.when((h == 0) & (li % 2 == 1) & (k == 0), F.col("span_start") + 1).when((h == 0) & (li == 0) & (k == 1), F.col("span_start") + 2).otherwise(F.col("span_start")))
    return C.structure(n, docs).select("node_id", "code")
