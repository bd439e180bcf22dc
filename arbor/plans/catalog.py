"""Queries of the catalog, of node changes, navigation and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import catalog as G
from arbor.operators import repository as R
from arbor.operators import validation as C
from arbor.operators.retrieval import unit
from arbor.plans.base import nodes_of, query, scratch, simple
from arbor.sources import corpus as S
from arbor.sources import files as X

_CATALOG = "WITH c AS (SELECT doc_id AS document_id, source || '/' || doc_id AS path, lang, 'hash-64' AS embedding_model, doc_id % 2 = 0 AS is_temporal FROM documents)"


def _catalog(spark, d):
    x = S.read(spark, d, "documents")
    return x.select(F.col("doc_id").alias("document_id"), F.concat_ws("/", "source", "doc_id").alias("path"), "lang", F.lit("hash-64").alias("embedding_model"), (F.col("doc_id") % 2 == 0).alias("is_temporal"))


@query("s11_list_documents", f"{_CATALOG} SELECT * FROM c")
def list_documents(spark, d):
    return G.find_documents(_catalog(spark, d))


@query("s11_documents_by_id_and_path", f"{_CATALOG} SELECT document_id, path, is_temporal FROM c WHERE starts_with(path, 'src1') AND document_id IN (SELECT doc_id FROM labels)")
def documents_by(spark, d):
    ids = S.read(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return G.find_documents(_catalog(spark, d), ids=ids, prefix="src1").select("document_id", "path", "is_temporal")


@query("d10_set_temporal", f"{_CATALOG} SELECT document_id, is_temporal OR document_id % 3 = 0 AS is_temporal FROM c")
def temporal(spark, d):
    c = _catalog(spark, d)
    return G.set_temporal(c, c.where("document_id % 3 = 0").select("document_id", F.lit(True).alias("is_temporal"))).select("document_id", "is_temporal")


simple("d01_batch_insert", lambda n: G.insert(n.where("height = 0"), n.where("height > 0"))[0].groupBy("document_id").agg(F.count("*").alias("n"), F.max("height").alias("height")), "SELECT document_id, count(*) AS n, max(height) AS height FROM nodes GROUP BY 1")
simple("d01_batch_insert_returned", lambda n: G.insert(n.where("height = 0"), n.where("height > 0 and document_id = 7"))[1].select("id"), "SELECT id FROM nodes WHERE height > 0 AND document_id = 7")
simple(
    "d05_set_fields",
    lambda n: G.set_fields(n.withColumn("cost", F.lit(0.0)), n.where("height = 0").select("id", F.concat(F.lit("ctx "), "id").alias("context"), (F.col("token_count") * 0.5).alias("cost"))).select("id", "context", "cost"),
    "SELECT id, CASE WHEN height = 0 THEN 'ctx ' || id END AS context, CASE WHEN height = 0 THEN token_count * 0.5 ELSE 0.0 END AS cost FROM nodes",
)
simple("f01_f04_filters", lambda n: n.where(G.translate({"document_id": 9, "span_end_lt": 3000, "span_overlaps": (500, 2500)})).select("id"), "SELECT id FROM nodes WHERE document_id = 9 AND span_end < 3000 AND span_start < 2500 AND span_end > 500")


@query("f11_scope_filter", "SELECT id FROM nodes WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)", nodes=True)
def scope(spark, d):
    return G.scoped(nodes_of(spark, d), S.read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))).select("id")


@query(
    "d11_vector_upsert",
    """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT id, CASE WHEN id % 10 = 0 THEN list_reverse(v) ELSE v END AS v FROM e)
 SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 9) AS last FROM r""",
)
def vector_upsert(spark, d):
    e = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("vec"), F.col("embedding").alias("raw"))
    new = G.upsert_vectors(e, e.where("id % 10 = 0").select("id", F.reverse("raw").alias("vec")))
    return new.select("id", F.round(F.element_at("vec", 1), 9).alias("first"), F.round(F.element_at("vec", -1), 9).alias("last"))


@query("s18_vector_snapshot", "SELECT vec_id, len(embedding) AS dims, CAST(label AS INT) AS label FROM embeddings")
def snapshot(spark, d):
    path = scratch(spark, "vectors")
    X.write_version(S.read(spark, d, "embeddings"), path)
    return X.load_vectors(spark, path, "vec_id long, embedding array<float>, label int").select("vec_id", F.size("embedding").cast("bigint").alias("dims"), "label")


@query("j13_vectors_in_order", """WITH q AS (SELECT user_id AS query_id, event_id % 700 AS id, row_number() OVER (PARTITION BY user_id
 ORDER BY event_id DESC) AS p FROM events) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS position FROM q
 JOIN embeddings ON vec_id = id""")
def vectors_in_order(spark, d):
    e = S.read(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.transform(F.reverse(F.array_sort(F.collect_list("event_id"))), lambda x: x % 700).alias("ids"))
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return G.vectors_of(e, v).select("query_id", "id", F.col("position").cast("bigint").alias("position"))


def _tiles(n):
    return n.where("parent_id is null").select(F.col("document_id").alias("query_id"), "document_id", "id", "height", "level_index", "span_start", "span_end", "token_count")


simple("d13_query_log_headers", lambda n: G.query_log(_tiles(n))[0], "SELECT document_id AS query_id, document_id, count(*) AS n_nodes, CAST(sum(token_count) AS BIGINT) AS tokens FROM nodes WHERE parent_id IS NULL GROUP BY document_id")
simple("d13_query_log_details", lambda n: G.query_log(_tiles(n))[1].withColumn("position", F.col("position").cast("bigint")), "SELECT document_id AS query_id, row_number() OVER (PARTITION BY document_id ORDER BY span_start, id) - 1 AS position, id AS node_id FROM nodes WHERE parent_id IS NULL")
simple(
    "d15_result_json",
    lambda n: G.result_json(_tiles(n)),
    """SELECT document_id AS query_id, '{"query_id":' || document_id || ',"nodes":[' || string_agg('{"id":"' || id || '","height":' || height ||
 ',"level_index":' || level_index || ',"span_start":' || span_start || ',"span_end":' || span_end || ',"token_count":' || token_count || '}', ','
 ORDER BY span_start, id) || ']}' AS json
 FROM nodes WHERE parent_id IS NULL GROUP BY document_id""",
)
simple("d15_r27_span_marks", G.span_marks, "SELECT id, token_count << height AS verbatim_tokens, '[' || span_start || '-' || span_end || ' h=' || height || ' verbatim=' || (token_count << height) || ']' AS mark FROM nodes")

simple("j02_missing_parents", lambda n: C.missing_parents(n.where("not (height = 1 and level_index % 2 = 0)")).select("node_id"), ", m AS (SELECT * FROM nodes WHERE NOT (height = 1 AND level_index % 2 = 0)) SELECT id AS node_id FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM m)")
simple("j04_missing_children", lambda n: C.missing_children(n.where("not (height = 0 and level_index % 3 = 0)")).groupBy("node_id").agg(F.count("*").alias("n")), """, m AS (SELECT * FROM nodes WHERE NOT (height = 0 AND level_index % 3 = 0))
 SELECT id AS node_id, (left_child_id NOT IN (SELECT id FROM m))::INT + (right_child_id NOT IN (SELECT id FROM m))::INT AS n FROM m
 WHERE height > 0 AND (left_child_id NOT IN (SELECT id FROM m) OR right_child_id NOT IN (SELECT id FROM m))""")
simple("j07_height_rule", lambda n: C.height_rule(n.withColumn("height", F.when((F.col("height") == 1) & (F.col("level_index") % 2 == 1), 4).otherwise(F.col("height")))).groupBy("code").agg(F.count("*").alias("n")), """, m AS (SELECT * REPLACE (CASE WHEN height = 1 AND level_index % 2 = 1 THEN 4 ELSE height END AS height)
 FROM nodes) SELECT 'coord.height_mismatch' AS code, count(*) AS n FROM m p JOIN m c ON c.id IN (p.left_child_id, p.right_child_id)
 WHERE p.height <> c.height + 1 HAVING n > 0""")
simple("j08_neighbor_chain", lambda n: C.neighbor_chain(n.withColumn("following_neighbor_id", F.when(F.col("level_index") % 4 == 2, F.col("preceding_neighbor_id")).otherwise(F.col("following_neighbor_id")))).select("node_id"), """, m AS (SELECT * REPLACE (CASE WHEN level_index % 4 = 2 THEN preceding_neighbor_id ELSE following_neighbor_id
 END AS following_neighbor_id) FROM nodes) SELECT a.id AS node_id FROM m a LEFT JOIN m b ON a.following_neighbor_id = b.id
 WHERE a.following_neighbor_id IS NOT NULL AND (b.id IS NULL OR b.height <> a.height OR b.level_index <> a.level_index + 1)""")
simple(
    "j10_c01_c04_navigate",
    lambda n: G.navigate(n, 2),
    """SELECT a.id AS source, a.parent_id AS parent, a.left_child_id AS left, a.right_child_id AS right, s.id AS sibling, b.id AS neighbor FROM nodes a
 LEFT JOIN nodes s ON s.document_id = a.document_id AND s.height = a.height AND s.level_index = xor(a.level_index, 1) LEFT
 JOIN nodes b ON b.document_id = a.document_id AND b.height = a.height AND b.level_index = a.level_index + 2
 WHERE coalesce(a.parent_id, a.left_child_id, s.id, b.id) IS NOT NULL""",
)
simple("j09_c05_ancestors", lambda n: R.ancestors(n.where("height = 0"), n).select("source", "id"), "SELECT a.id AS source, b.id FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND b.height > 0 AND b.level_index = a.level_index >> b.height WHERE a.height = 0")
simple("c02_children", lambda n: R.children(n).select("id", "left", "right"), "SELECT id, left_child_id AS left, right_child_id AS right FROM nodes")
simple("c04_walk", lambda n: G.walk(n.where("height = 0"), 3).withColumn("step", F.col("step").cast("bigint")), """SELECT a.id AS source, b.level_index - a.level_index AS step, b.id FROM nodes a
 JOIN nodes b ON a.document_id = b.document_id AND a.height = 0 AND b.height = 0 AND b.level_index - a.level_index BETWEEN 1 AND 3""")
simple("c06_descendants", lambda n: G.descendants(n, 2), "SELECT a.id AS source, b.id FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND a.height - b.height BETWEEN 1 AND 2 AND b.level_index >> (a.height - b.height) = a.level_index")
simple("c09_within_leaf_range", lambda n: R.within_leaves(n, 2, 9).select("id"), "SELECT id FROM nodes WHERE level_index << height >= 2 AND ((level_index + 1) << height) - 1 <= 9")

simple("a07_costs", lambda n: R.cost_stats(n.withColumn("cost", F.col("token_count") * 0.25 + F.col("height"))), """SELECT document_id, sum(token_count * 0.25 + height) AS cost, count(*) AS n_nodes, count(*) FILTER (height =
 0) AS n_leaves, count(*) FILTER (height > 0) AS n_summaries FROM nodes GROUP BY 1""")
simple("a12_validation_metrics", lambda n: R.validation_metrics(n), """SELECT document_id, count(*) AS n_nodes, count(*) FILTER (height = 0) AS n_leaves, count(*) FILTER (parent_id
 IS NULL) AS n_roots, count(*) FILTER (height > 0 AND left_child_id IS NULL) AS no_children, count(*) FILTER (span_end <= span_start) AS empty_spans,
 count(*) FILTER (token_count = 0) AS no_tokens FROM nodes GROUP BY 1""")
simple("a17_root_stats", lambda n: R.root_stats(n), "SELECT document_id, CAST(sum(token_count) AS BIGINT) AS tokens, max(height) AS height, count(*) AS n_roots FROM nodes WHERE parent_id IS NULL GROUP BY 1")


@query("a08_time_range", "SELECT conv_id AS document_id, min(turn * 60.0) AS time_start, max(turn * 60.0) AS time_end FROM conversations GROUP BY 1")
def time_range(spark, d):
    return S.units(S.read(spark, d, "conversations")).groupBy("document_id").agg(F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"))


simple("t08_first_violations", lambda n: C.first_findings(C.missing_parents(n.where("height <> 1")), 10), "SELECT document_id, 'parent.missing' AS code, id AS node_id FROM nodes WHERE height = 0 AND parent_id IS NOT NULL ORDER BY document_id, code, node_id LIMIT 10")
simple("t10_b18_first_jobs", lambda n: G.jobs(n.withColumn("parent_id", F.when(F.col("height") > 0, F.col("parent_id"))), 6).select("id", "kind", F.col("rank").cast("bigint").alias("rank")), """, m AS (SELECT * REPLACE (CASE WHEN height > 0 THEN parent_id END AS parent_id)
 FROM nodes), j AS (SELECT document_id, span_start, 'embed' AS kind, id FROM m WHERE height = 0
 UNION ALL SELECT document_id, span_start, 'summarise', id FROM m a WHERE parent_id IS NULL AND level_index % 2 = 0 AND EXISTS (SELECT 1
 FROM m b WHERE b.document_id = a.document_id AND b.height = a.height AND b.level_index = a.level_index + 1 AND b.parent_id IS NULL))
 SELECT id, kind, row_number() OVER (PARTITION BY document_id ORDER BY span_start, kind, id) AS rank FROM j QUALIFY rank <= 6""")
simple("t11_outliers", lambda n: n.join(n.groupBy("height").agg(F.avg("token_count").alias("mean"), F.stddev_pop("token_count").alias("std")), "height").where("abs(token_count - mean) > 2 * std").select("id"), ", sd AS (SELECT height, avg(token_count) AS mean, stddev_pop(token_count) AS std FROM nodes GROUP BY 1) SELECT id FROM nodes JOIN sd USING (height) WHERE abs(token_count - mean) > 2 * std")

_EVENTS_REC = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'system' ELSE 'tool' END AS type, event_id %
 10 = 0 AS is_compact, event_id % 9 = 0 AS is_meta, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events"""


@query("f09_included_records", f"SELECT event_id FROM ({_EVENTS_REC}) WHERE type IN ('user', 'assistant') AND NOT is_compact AND NOT is_meta AND ts IS NOT NULL")
def included(spark, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("user", "assistant", "system", "tool")]), (e % 4 + 1).cast("int"))
    r = S.read(spark, d, "events").select("event_id", kind.alias("type"), (e % 10 == 0).alias("is_compact"), (e % 9 == 0).alias("is_meta"), F.when(e % 11 != 0, F.col("ts")).alias("ts"))
    return G.included(r).select("event_id")


@query("s15_s16_reverse_lines", "SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY 1")
def reverse_lines(spark, d):
    """Events written as JSON lines in the order of their ids; the first line of a user in the reverse scan is the last event."""
    path = scratch(spark, "jsonl")
    S.read(spark, d, "events").select("event_id", "user_id").orderBy("event_id").write.json(path)
    lines = X.numbered_lines(spark, path).withColumn("r", F.from_json("line", "event_id long, user_id long")).select("path", "block", "line_no", "r.*")
    return lines.groupBy("user_id").agg(F.max_by("event_id", F.struct("path", "block", "line_no")).alias("last_event"), F.count("*").alias("n"))


@query("s19_matched_runs", """SELECT 'type=' || event_type AS name, event_type <> (SELECT max(event_type)
 FROM events) AS in_baseline, event_type <> (SELECT min(event_type) FROM events) AS in_current FROM (SELECT DISTINCT event_type FROM events)""")
def matched_runs(spark, d):
    """Telemetry of two runs in a folder a type: the baseline lacks the last type, the current run the first."""
    e = S.read(spark, d, "events").select(F.concat(F.lit("type="), "event_type").alias("run"), "event_id", "value")
    ends = e.agg(F.min("run").alias("lo"), F.max("run").alias("hi"))
    runs = []
    for drop in ("hi", "lo"):
        path = scratch(spark, "runs")
        e.join(F.broadcast(ends), F.col("run") != F.col(drop)).select("run", "event_id", "value").write.partitionBy("run").json(path)
        files = G.glob_files(spark, path, "*.json")
        runs.append(files.select(F.url_decode(F.regexp_extract("path", r"run=([^/]+)/", 1)).alias("name")))
    return G.matched_runs(*runs)


@query("s20_qa_sessions", "SELECT conv_id AS sample_id, turn // 3 + 1 AS session, row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) - 1 AS position, text FROM conversations")
def qa_sessions(spark, d):
    c = S.read(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 3).alias("k")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    c = c.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), (F.col("k") + 1).cast("string")), F.col("a.text"))))).alias("json"))
    return G.qa_sessions(c.withColumnRenamed("conv_id", "sample_id"), "json").withColumn("position", F.col("position").cast("bigint"))


@query("s21_transcript_dialects", "SELECT conv_id, turn, role, text FROM conversations")
def dialects(spark, d):
    c = S.read(spark, d, "conversations")
    a = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    b = F.to_json(F.struct("role", F.array(part("image", F.lit("x")), part("text", F.col("text"))).alias("content")))
    m = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("message")))
    k = (F.col("conv_id") + F.col("turn")) % 3
    records = c.select("conv_id", "turn", F.when(k == 0, a).when(k == 1, b).otherwise(m).alias("json"))
    return G.messages(records, "json").select("conv_id", "turn", "role", "text")


@query("m21_verdicts", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'B' END AS verdict FROM events")
def verdicts(spark, d):
    """Judge answers as plain JSON, fenced JSON, JSON in lower case, prose, and without a verdict."""
    e = F.col("event_id") % 5
    answer = F.when(e == 0, '{"verdict": "A"}').when(e == 1, 'Here:\n```json\n{"verdict": "B", "why": "x"}\n```').when(e == 2, '{"verdict": "c"}').when(e == 3, "My verdict: b, clearly").otherwise('{"score": 1}')
    return S.read(spark, d, "events").select("event_id", G.verdict(answer).alias("verdict"))


@query("sf_lenient_booleans", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM events")
def lenient(spark, d):
    e = F.col("event_id") % 4
    return S.read(spark, d, "events").select("event_id", G.truthy(F.when(e == 0, " Yes").when(e == 1, "OFF").when(e == 2, "1").otherwise("maybe")).alias("flag"))
