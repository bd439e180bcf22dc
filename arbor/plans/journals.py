"""Queries of files, journals, versions and what spans several operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbor.functions import texts as TX
from arbor.operators import evaluation as E
from arbor.operators import navigation as N
from arbor.operators import retrieval as V
from arbor.operators import telemetry as T
from arbor.operators.splitter import split_documents
from arbor.plans.analytics import ATTEMPTS
from arbor.plans.base import nodes_of, query
from arbor.plans.base import scratch
from arbor.sources import corpus as S
from arbor.sources import files as X


def _events(spark, d):
    return S.read(spark, d, "events")


@query("s13_text_files", "SELECT event_type, CAST(sum(length(event_id || ' ' || user_id) + 1) AS BIGINT) AS n_chars, count(*) AS n_lines FROM events GROUP BY 1")
def text_files(spark, d):
    """Lines written as text files, a folder a type, read as whole files."""
    path = scratch(spark, "texts")
    _events(spark, d).select("event_type", F.concat_ws(" ", "event_id", "user_id").alias("line")).write.partitionBy("event_type").text(path)
    t = X.read_texts(spark, f"{path}/*/*.txt").withColumn("event_type", F.url_decode(F.regexp_extract("path", r"event_type=([^/]+)/", 1)))
    return t.groupBy("event_type").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("n_lines"))


def _jsonl(spark, d) -> str:
    """One line an event in the order of ids; every fifth is broken, every seventh blank, every eleventh a list."""
    path = scratch(spark, "jsonl")
    e = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "user_id"))
    line = F.when(e % 5 == 0, F.substring(whole, 1, 12)).when(e % 7 == 0, F.lit("")).when(e % 11 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    _events(spark, d).orderBy("event_id").select(line.alias("value")).write.text(path)
    return path


@query("s17_journal_file", "SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def journal_file(spark, d):
    return X.read_jsonl(spark, _jsonl(spark, d), "event_id long, user_id long").select("event_id", "user_id")


@query("s15_scan_from_offset", "SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY 1")
def scan_from(spark, d):
    """Two scans of the files: up to byte 500, then from the first line that begins there on."""
    path = _jsonl(spark, d)
    x = X.scan_from(spark, path, 0, "event_id long, user_id long").where("offset < 500").unionByName(X.scan_from(spark, path, 500, "event_id long, user_id long"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("d14_journal_append_and_reset", "SELECT event_id, user_id FROM events WHERE event_id % 4 IN (1, 2)")
def append_and_reset(spark, d):
    """A journal in two appends; the metadata beside it in three versions, of which the last is empty and the one before counts."""
    path = scratch(spark, "journal")
    e = _events(spark, d).select("event_id", "user_id")
    for k in (1, 2):
        X.append_journal(e.where(F.col("event_id") % 4 == k), f"{path}/log")
    X.write_version(e.where("event_id % 4 = 0"), f"{path}/meta")
    X.reset(spark, f"{path}/meta", "event_id long, user_id long")
    log = X.read_jsonl(spark, f"{path}/log", "event_id long, user_id long").select("event_id", "user_id")
    return log.unionByName(X.read_version(spark, f"{path}/meta"))


@query("d18_versions", "SELECT event_id FROM events WHERE event_id % 3 = 2")
def versions(spark, d):
    """Each version replaces the whole; the current one is the last."""
    path = scratch(spark, "table")
    for k in range(3):
        X.write_version(_events(spark, d).select("event_id").where(F.col("event_id") % 3 == k), path)
    return X.read_version(spark, path)


@query("st04_m24_node_fold", """SELECT event_id % 997 AS node_id, epoch_us(min(ts)) AS created_us, arg_max(event_id % 5, (ts, event_id)) AS height,
 arg_max(event_id, (ts, event_id)) AS span_start, arg_max(event_id + 10, (ts, event_id)) AS span_end, count(*) AS n_commits FROM events
 WHERE event_id % 4 = 1 GROUP BY 1""")
def node_fold(spark, d):
    e = F.col("event_id")
    c = _events(spark, d).where(e % 4 == 1).select((e % 997).alias("node_id"), "event_id", "ts", (e % 5).alias("height"), e.alias("span_start"), (e + 10).alias("span_end"))
    return T.fold_nodes(c).select("node_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "height", "span_start", "span_end", "n_commits")


@query("st04_append_history", """WITH j AS (SELECT event_id, user_id AS append_id, ts, CASE event_id % 4 WHEN 0 THEN 'in_progress' WHEN 2 THEN
 'completed' ELSE 'failed' END AS status FROM events WHERE event_id % 4 <> 1)
 SELECT append_id, arg_min(event_id, (ts, event_id)) AS first_seen, arg_max(status, (ts, event_id)) AS status, epoch_us(max(ts) FILTER (status =
 'in_progress')) AS started_us, epoch_us(max(ts) FILTER (status <> 'in_progress')) AS ended_us FROM j GROUP BY 1
 HAVING arg_max(status, (ts, event_id)) <> 'in_progress'""")
def history(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return T.append_history(S.journal(_events(spark, d))).select("append_id", "first_seen", "status", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"))


@query("j16_three_sources", """SELECT user_id, coalesce(max(event_id) FILTER (event_id % 3 = 2), max(event_id) FILTER (event_id % 3 = 1), max(event_id)
 FILTER (event_id % 3 = 0)) AS last FROM events WHERE event_id % 7 = 0 GROUP BY 1""")
def three_sources(spark, d):
    part = lambda k: _events(spark, d).where((F.col("event_id") % 7 == 0) & (F.col("event_id") % 3 == k)).groupBy("user_id").agg(F.max("event_id").alias("last"))
    return E.merged(E.merged(part(0), part(1), "user_id", ["last"]), part(2), "user_id", ["last"])


@query("a22_telemetry_statistics", ATTEMPTS + """, n AS (SELECT node_id, count(*) AS k, max(end_time) - min(start_time) FILTER (start_time > 0) AS lat FROM a GROUP BY 1)
 SELECT 'nodes' AS metric, count(*)::DOUBLE AS value FROM acc UNION ALL SELECT 'mean_deviation', avg((actual_tokens - target_tokens) / target_tokens::DOUBLE * 100) FROM acc
 UNION ALL SELECT 'verbatim', count(*) FILTER (abs(actual_tokens / prompt_tokens::DOUBLE - 1) <= 0.02)::DOUBLE FROM acc WHERE prompt_tokens > 0
 UNION ALL SELECT 'retries', sum(k - 1)::DOUBLE FROM n UNION ALL SELECT 'mean_latency', avg(lat) FROM n""")
def statistics(spark, d):
    """One table of the run's figures, each from its own operator."""
    a = S.attempts(_events(spark, d))
    acc = E.accepted_attempts(a)
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    out = one(acc, "nodes", F.count("*"))
    out = out.unionByName(one(acc, "mean_deviation", F.avg((F.col("actual_tokens") - F.col("target_tokens")) / F.col("target_tokens") * 100)))
    out = out.unionByName(one(E.verbatim_by_height(acc), "verbatim", F.sum("verbatim")))
    out = out.unionByName(one(a.groupBy("node_id").agg((F.count("*") - 1).alias("k")), "retries", F.sum("k")))
    return out.unionByName(one(E.latencies(a), "mean_latency", F.avg("latency")))


@query(
    "r06_hybrid_fused_order",
    """WITH a AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
 FROM events WHERE user_id % 4 <> 0 QUALIFY r <= 20), b AS (SELECT user_id AS query_id, event_id AS k, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id) AS r FROM events QUALIFY r <= 20),
 f AS (SELECT query_id, k, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score, a.r AS ra, b.r AS rb
 FROM a FULL JOIN b USING (query_id, k))
 SELECT query_id, k, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, k) AS INT) AS rank FROM f
 WHERE k % 5 <> 0 AND query_id IN (SELECT query_id FROM a)""",
)
def hybrid(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("k"), "value", "ts")
    rank = lambda x, c: x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "k"))).where("rank <= 20")
    vector = rank(e.where("query_id % 4 <> 0"), "value")
    fused = V.reciprocal_rank_fusion(vector, rank(e, "ts"), "k")
    return N.hybrid_in_fused_order(vector, fused, e.where("k % 5 <> 0").select("k"), "k").select("query_id", "k", "rank")


@query("s12_pinned_nodes", """SELECT n.id FROM nodes n WHERE (level_index + height) % 3 = 0 AND (SELECT count(*) FROM nodes p
 WHERE p.document_id = n.document_id AND p.height > n.height AND p.level_index = n.level_index >> (p.height - n.height)) <= 2""", nodes=True)
def pinned(spark, d):
    n = nodes_of(spark, d).withColumn("pinned", (F.col("level_index") + F.col("height")) % 3 == 0)
    return N.pinned_nodes(n, S.sizes(S.read(spark, d, "documents")), 2).select("id")


@query("b01_b03_pieces_rebuild", "SELECT doc_id AS document_id, length(regexp_replace(text, '[ \\n\\t\\r]+', '', 'g')) AS n, true AS exact FROM documents WHERE length(regexp_replace(text, '[ \\n\\t\\r]+', '', 'g')) > 0")
def rebuild(spark, d):
    """Pieces are what their spans say, none is too large, and all characters but blanks are in one of them."""
    docs = S.read(spark, d, "documents")
    p = split_documents(docs, 100).join(docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("whole")), "document_id")
    cut = F.substring("whole", (F.col("span_start") + 1).cast("int"), (F.col("span_end") - F.col("span_start")).cast("int"))
    fits = F.col("span_end") - F.col("span_start") <= 4 * 100 + 3
    dense = F.length(F.regexp_replace("text", "[ \n\t\r]+", ""))
    return p.groupBy("document_id").agg(F.sum(dense).alias("n"), F.every((cut == F.col("text")) & fits).alias("exact"))


@query("sf_truncated_tokens", "SELECT doc_id, md5(substring(text, 1, 200)) AS head, md5(CASE WHEN length(text) > 200 THEN right(text, 200) ELSE text END) AS tail FROM documents")
def truncated(spark, d):
    t = S.read(spark, d, "documents")
    return t.select("doc_id", F.md5(TX.keep_tokens(F.col("text"), F.lit(50)).cast("binary")).alias("head"), F.md5(TX.keep_tokens(F.col("text"), F.lit(50), True).cast("binary")).alias("tail"))


@query("sf_times", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS spoken FROM events")
def times(spark, d):
    t = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    said = F.concat(F.lower(F.date_format(t, "h:mm a")), F.lit(" on "), F.date_format(t, "d MMMM, yyyy"))
    return _events(spark, d).select("event_id", TX.iso_time(F.unix_timestamp(t)).alias("iso"), TX.spoken_time(said).alias("spoken"))


@query("sf_lenient_numbers", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 0 ELSE 0 END AS n, CASE WHEN
 event_id % 4 = 1 THEN event_id + 0.5::DOUBLE WHEN event_id % 4 = 0 THEN event_id::DOUBLE END AS x, 'a_b-' || event_id || '.c_' AS id FROM events""")
def numbers(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat(F.lit(" "), e.cast("string"))).when(e % 4 == 1, F.concat(e.cast("string"), F.lit(".5"))).when(e % 4 == 2, "many")
    return _events(spark, d).select("event_id", TX.lenient_int(text, 0).alias("n"), TX.lenient_float(text).alias("x"), TX.safe_id(F.concat(F.lit("a b-"), e.cast("string"), F.lit(".c/"))).alias("id"))


@query("sf_mean_vectors", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i
 FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
 SELECT CAST(label AS INT) AS label, round(max(m) FILTER (i = 0), 8) AS first, round(max(m) FILTER (i = 63), 8) AS last FROM m GROUP BY 1""")
def mean_vectors(spark, d):
    """Means inside blocks of vectors, then of the blocks by their sizes: no label is one array."""
    e = S.read(spark, d, "embeddings").withColumn("b", F.col("vec_id") % 16)
    part = e.groupBy("label", "b").agg(TX.mean_vector(F.collect_list("embedding")).alias("m"), F.count("*").alias("n"))
    total = part.groupBy("label").agg(*[(F.sum(F.element_at("m", k) * F.col("n")) / F.sum("n")).alias(c) for k, c in ((1, "first"), (-1, "last"))])
    return total.select("label", F.round("first", 8).alias("first"), F.round("last", 8).alias("last"))


@query("w03_w05_leaf_windows", """, l AS (SELECT *, lag(span_end) OVER (PARTITION BY document_id ORDER BY span_start, level_index) AS b FROM nodes
 WHERE height = 0 AND NOT (document_id % 3 = 0 AND level_index = 0) AND level_index % 4 <> 2)
 SELECT document_id, min_by(span_start, (span_start, level_index)) AS starts_at, count(*) FILTER (b <> span_start) AS gaps FROM l GROUP BY 1""", nodes=True)
def leaf_windows(spark, d):
    """Where each document's first leaf begins, and the gaps between its leaves."""
    n = nodes_of(spark, d).where("height = 0 and not (document_id % 3 = 0 and level_index = 0) and level_index % 4 <> 2")
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index")
    x = n.withColumn("before", F.lag("span_end").over(w))
    return x.groupBy("document_id").agg(F.min_by("span_start", F.struct("span_start", "level_index")).alias("starts_at"), F.count_if(F.col("before") != F.col("span_start")).alias("gaps"))
