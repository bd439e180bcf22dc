"""Queries of bulk changes, repairs and splitting, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import maintenance as M
from arbor.operators import repository as R
from arbor.plans.base import nodes_of, query, simple
from arbor.sources import corpus as S

UNITS = """WITH u AS (SELECT conv_id AS document_id, row_number() OVER w - 1 AS level_index, CAST(sum(length(coalesce(text, ''))) OVER w -
 length(coalesce(text, '')) AS BIGINT) AS span_start, CAST(sum(length(coalesce(text, ''))) OVER w AS BIGINT) AS span_end, turn
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) """


def _units(spark, d):
    return S.units(S.read(spark, d, "conversations"))


simple("s02_multi_get", lambda n: R.multi_get(n, n.where("height = 1").select(F.col("left_child_id").alias("id"))).select("id"), "SELECT left_child_id AS id FROM nodes WHERE height = 1")
simple("s05_scan_by_span", lambda n: n.where("height = 0").orderBy("document_id", "span_start", "level_index").select("id", "span_start"), "SELECT id, span_start FROM nodes WHERE height = 0")
simple("f07_leaves_from", lambda n: n.where("height = 0 and span_start >= 1500").select("id", "span_start"), "SELECT id, span_start FROM nodes WHERE height = 0 AND span_start >= 1500")
simple("f12_snapshot", lambda n: n.select("id", "height", "span_start", "span_end", (F.col("height") == 0).alias("is_leaf"), "parent_id"), "SELECT id, height, span_start, span_end, height = 0 AS is_leaf, parent_id FROM nodes")
simple("f13_a15_health", lambda n: M.health(n.where("not (height = 2 and level_index = 0)"), F.col("level_index") % 4), """, m AS (SELECT * FROM nodes WHERE NOT (height = 2 AND level_index = 0))
 SELECT count(*) AS n, count(*) FILTER (level_index % 4 = 0) AS no_time, count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id
 FROM m)) AS orphans FROM m""")
simple("d03_bulk_update", lambda n: M.bulk_update(n, n.where("height = 1").select("id", (F.col("token_count") * 2).alias("token_count")), "token_count").select("id", "token_count"), "SELECT id, CASE WHEN height = 1 THEN 2 * token_count ELSE token_count END AS token_count FROM nodes")
simple("d04_relink", lambda n: M.relink(n.where("not (height = 0 and level_index = 1)")).select("id", "preceding_neighbor_id", "following_neighbor_id"), """, m AS (SELECT * FROM nodes WHERE NOT (height = 0 AND level_index = 1))
 SELECT m.id, p.id AS preceding_neighbor_id, f.id AS following_neighbor_id FROM m LEFT JOIN m p ON m.preceding_neighbor_id = p.id LEFT
 JOIN m f ON m.following_neighbor_id = f.id""")
simple("d09_clear_documents", lambda n: n.join(n.where("document_id % 3 = 0").select("document_id").distinct(), "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("n")), "SELECT document_id, count(*) AS n FROM nodes WHERE document_id % 3 <> 0 GROUP BY 1")
simple("d17_prune_roots", lambda n: M.prune_roots(n, n.where("parent_id is null and height = 2")).select("id", "parent_id", "following_neighbor_id"), """, m AS (SELECT * FROM nodes WHERE NOT (parent_id IS NULL AND height = 2))
 SELECT m.id, p.id AS parent_id, f.id AS following_neighbor_id FROM m LEFT JOIN m p ON m.parent_id = p.id LEFT
 JOIN m f ON m.following_neighbor_id = f.id""")
simple("j18_st06_catalog_diff", lambda n: M.diff(n.where("level_index <> 1"), n.where("height <> 1").withColumn("token_count", F.when(F.col("height") == 2, 0).otherwise(F.col("token_count"))), "id", ["token_count", "parent_id"]), """, d AS (SELECT id, CASE WHEN height = 1 AND level_index <> 1 THEN 'removed' WHEN height <> 1 AND level_index
 = 1 THEN 'added' WHEN height = 2 AND level_index <> 1 AND token_count <> 0 THEN 'changed' END AS kind FROM nodes) SELECT * FROM d
 WHERE kind IS NOT NULL""")
simple("b10_eligible_pairs", lambda n: M.eligible_pairs(n.where("height = 0").select("document_id", "id", "height", "level_index", "span_start")), """SELECT a.document_id, a.id AS left_id, b.id AS right_id, a.height FROM nodes a
 JOIN nodes b ON a.document_id = b.document_id AND a.height = b.height AND b.level_index = a.level_index + 1
 WHERE a.height = 0 AND a.level_index % 2 = 0""")
simple("w09_gated_pairs", lambda n: M.eligible_pairs(n.where("height = 1 or height = 0 and level_index = 8"), 1), """, m AS (SELECT *, min(height) OVER w AS low, lead(id) OVER w AS right_id, lead(height) OVER w AS rh,
 lead(level_index) OVER w AS ri FROM nodes WHERE height = 1 OR height = 0 AND level_index = 8 WINDOW w AS (PARTITION BY document_id
 ORDER BY span_start, level_index)) SELECT document_id, id AS left_id, right_id, height FROM m
 WHERE rh = height AND level_index % 2 = 0 AND ri = level_index + 1 AND height + 1 - low <= 1""")
simple("b12_b13_summary_target", lambda n: n.select("id", M.passthrough(F.col("token_count"), F.col("height")).alias("target")), "SELECT id, CASE WHEN token_count >> height < 50 THEN 0 ELSE token_count >> height END AS target FROM nodes")
simple("w08_frontier", lambda n: R.completion_frontier(n.where("height = 1 or height = 0 and level_index > 2").withColumn("parent_id", F.lit(None).cast("string")), 0.7), """, r AS (SELECT *, sum(1 << height) OVER w AS n, count(*) OVER w AS k, max(height) OVER w AS h
 FROM nodes WHERE height = 1 OR height = 0 AND level_index > 2 WINDOW w AS (PARTITION BY document_id
 ORDER BY span_start, level_index ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT document_id, span_start, CASE WHEN n <= 1 THEN 1.0 ELSE CAST(bit_count(CAST(n AS BIGINT)) + length(bin(CAST(n AS BIGINT))) - 1 AS
 DOUBLE) / (k + h) END AS c FROM r) SELECT document_id, min(span_start) FILTER (c < 0.7) AS frontier, min(c) AS least_completeness FROM c GROUP BY 1""")


@query("s14_char_chunks", """WITH s AS (SELECT doc_id, text, length(text) AS n, CAST(ceil(length(text) / 8.0) AS BIGINT) AS size FROM documents
 WHERE length(text) > 0), e AS (SELECT *, unnest(range(0, CAST(ceil(n / CAST(size AS DOUBLE)) AS BIGINT))) AS part FROM s)
 SELECT doc_id, CAST(part AS INT) AS part, substring(text, part * size + 1, size) AS chunk FROM e""")
def char_chunks(spark, d):
    return M.char_chunks(S.read(spark, d, "documents"), 8).select("doc_id", "part", "chunk")


@query("s17_journal_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0""")
def journal_json(spark, d):
    lines = S.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("line"))
    return lines.withColumn("r", F.from_json("line", "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})).where("r is not null and r._bad is null").select("event_id", "r.k")


@query("d08_truncate_by_time", UNITS + """, g AS (SELECT *, turn * 7 % 5 * 60.0 > 150 AS gone FROM u), s AS (SELECT *, coalesce(sum(CASE WHEN gone THEN
 span_end - span_start END) OVER (PARTITION BY document_id ORDER BY span_start, level_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS
 shift FROM g) SELECT document_id, level_index, CAST(span_start - shift AS BIGINT) AS span_start, CAST(span_end - shift AS BIGINT) AS span_end
 FROM s WHERE NOT gone""")
def truncate_by_time(spark, d):
    u = _units(spark, d).withColumn("time_end", F.col("time_end") / 60 * 7 % 5 * 60)
    return M.truncate_by_time(u, 150.0).select("document_id", "level_index", "span_start", "span_end")


@query("d12_delete_vectors", "SELECT vec_id FROM embeddings WHERE label <> 3")
def delete_vectors(spark, d):
    v = S.read(spark, d, "embeddings")
    return M.delete_vectors(v, v.where("label = 3")).select("vec_id")


@query("d16_repair_times", UNITS + """, t AS (SELECT document_id, level_index, CAST(CASE WHEN turn % 3 = 1 THEN 0 ELSE turn * 60 + 1 END AS DOUBLE) AS t
 FROM u) SELECT document_id, level_index, t = 0 AS repaired, CASE WHEN t <> 0 THEN t ELSE coalesce((SELECT max(b.t) FROM t b
 WHERE b.document_id = a.document_id AND b.level_index < a.level_index AND b.t <> 0), (SELECT min(b.t) FROM t b
 WHERE b.document_id = a.document_id AND b.level_index > a.level_index AND b.t <> 0)) END AS time_start, CASE WHEN t <> 0 THEN t ELSE
 coalesce((SELECT min(b.t) FROM t b WHERE b.document_id = a.document_id AND b.level_index > a.level_index AND b.t <> 0), (SELECT max(b.t)
 FROM t b WHERE b.document_id = a.document_id AND b.level_index < a.level_index AND b.t <> 0)) END AS time_end FROM t a""")
def repair_times(spark, d):
    t = F.when(F.col("time_start") / 60 % 3 == 1, 0.0).otherwise(F.col("time_start") + 1)
    u = _units(spark, d).withColumn("time_end", t).withColumn("time_start", F.col("time_end"))
    return M.repair_times(u).select("document_id", "level_index", "repaired", "time_start", "time_end")


@query("b05_adjacent", UNITS + "SELECT document_id, level_index, lag(level_index) OVER w AS before, lead(level_index) OVER w AS after FROM u WINDOW w AS (PARTITION BY document_id ORDER BY level_index)")
def adjacent(spark, d):
    return M.adjacent(_units(spark, d)).select("document_id", "level_index", "before", "after")


@query("f10_g10_units_not_blank", "SELECT conv_id, turn, substring(text, 1, 50000) AS text FROM conversations WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def units_not_blank(spark, d):
    return S.read(spark, d, "conversations").where(F.col("text").rlike(r"[^ \t\n\r]")).select("conv_id", "turn", F.substring("text", 1, 50000).alias("text"))


@query("f10_g10_units_whole", "SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def units_whole(spark, d):
    """Normal mode: blank units go, the others keep their whole text."""
    return S.read(spark, d, "conversations").where(F.col("text").rlike(r"[^ \t\n\r]")).select("conv_id", "turn", "text")


@query("f10_b20_client_units", "SELECT conv_id, turn, substring(text, 1, 50000) AS text FROM conversations")
def client_units(spark, d):
    """Client-managed chunking: all units, blank ones too, cut at 50,000 characters."""
    return S.read(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 50000).alias("text"))


@query("j14_v10_orphan_vectors", """SELECT vec_id AS key, 'vector.orphan' AS code FROM embeddings WHERE vec_id NOT IN (SELECT doc_id
 FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, 'vector.missing' FROM documents
 WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def orphan_vectors(spark, d):
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("key"))
    x = S.read(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"))
    return v.join(x, "key", "left_anti").withColumn("code", F.lit("vector.orphan")).unionByName(x.join(v, "key", "left_anti").withColumn("code", F.lit("vector.missing")))


@query("v09_chunk_size", "SELECT document_id, 'leaf.too_large' AS code, id AS node_id FROM nodes WHERE height = 0 AND token_count > 90", nodes=True)
def chunk_size(spark, d):
    from arbor.operators.validation import chunk_size as check

    return check(nodes_of(spark, d), 90)


@query("a14_duplicate_coordinates", "SELECT document_id, 'coord.duplicate' AS code, id AS node_id FROM nodes WHERE height = 1 UNION ALL SELECT document_id, 'coord.duplicate', id FROM nodes WHERE height = 1", nodes=True)
def duplicates(spark, d):
    from arbor.operators.validation import coordinates

    n = nodes_of(spark, d)
    return coordinates(n.unionByName(n.where("height = 1"))).where("code = 'coord.duplicate'")


@query("b01_character_pieces", """WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS t FROM documents),
 k AS (SELECT *, unnest(range(0, CAST(ceil(length(t) / 403.0) AS BIGINT))) AS k FROM t)
 SELECT doc_id AS document_id, CAST(k AS INTEGER) AS level_index, k * 403 AS span_start, least(CAST(length(t) AS BIGINT), k * 403 + 403) AS span_end,
 md5(substring(t, k * 403 + 1, 403)) AS digest FROM k""")
def character_pieces(spark, d):
    """Texts without any separator are cut at characters."""
    from arbor.operators.splitter import split_documents

    plain = S.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z0-9]", "").alias("text"))
    return split_documents(plain, 100).select("document_id", "level_index", "span_start", "span_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("b03_blank_pieces", """WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '([A-Za-z0-9]{50})', '\\1 ', 'g') AS t
 FROM documents), g AS (SELECT doc_id, t AS rest, CAST(0 AS BIGINT) AS pos, 0 AS k, '' AS piece FROM t WHERE t <> '' UNION ALL
 SELECT doc_id, substring(rest, n + 1), pos + n, k + 1, substring(rest, 1, n) FROM (SELECT *, CAST(CASE WHEN length(rest) <= 403 THEN length(rest)
 ELSE 404 - strpos(reverse(substring(rest, 1, 403)), ' ') END AS BIGINT) AS n FROM g WHERE rest <> ''))
 SELECT doc_id AS document_id, k - 1 AS level_index, pos - length(piece) AS span_start, pos AS span_end, md5(piece) AS digest FROM g WHERE trim(piece) <> ''""")
def blank_pieces(spark, d):
    """Texts of words of at most 50 letters are cut after the last blank that fits."""
    from arbor.operators.splitter import split_documents

    plain = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), "([A-Za-z0-9]{50})", "$1 ")
    p = split_documents(S.read(spark, d, "documents").select("doc_id", plain.alias("text")), 100)
    return p.select("document_id", "level_index", "span_start", "span_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("b01_b03_split")
def split(spark, d):
    from arbor.operators.splitter import split_documents

    return split_documents(S.read(spark, d, "documents"), 100)
