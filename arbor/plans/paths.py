"""Queries of the query path and of building, appending and synchronising, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arbor.operators import build as B
from arbor.operators import query_path as P
from arbor.operators import retrieval as V
from arbor.plans.base import NODES, nodes_of, query, scratch, simple
from arbor.sources import corpus as S
from arbor.streaming import builder
from arbor.streaming.sync import sync as sync_log
from arbor.streaming.sync import sync_by_bucket

_SEEDS = "height = 0 and level_index % 5 = 3"


def _seeds(n):
    return n.where(_SEEDS).select(F.col("document_id").alias("query_id"), "document_id", "height", "level_index")


def _windows(n):
    """All leaves but the first two and the last, of documents with four leaves or more."""
    last = n.where("height = 0").groupBy("document_id").agg(F.max("level_index").alias("last")).where("last >= 3")
    return last.select(F.col("document_id").alias("query_id"), "document_id", F.lit(2).cast("bigint").alias("lo"), (F.col("last") - 1).alias("hi"))


_COVER = """, t AS (SELECT document_id, max(height) AS t, max(level_index) FILTER (height = 0) AS last FROM nodes
 GROUP BY 1), win AS (SELECT document_id, t, {lo} AS lo, {hi} AS hi FROM t WHERE {some}),
 sd AS (SELECT document_id, height, level_index FROM nodes JOIN win USING (document_id) WHERE height = 0 AND level_index % 5 = 3
  UNION SELECT document_id, list_max(list_filter(range(0, t + 1), lambda k: lo % (1 << k) = 0 AND lo + (1 << k) - 1 <= hi)), lo >>
 list_max(list_filter(range(0, t + 1), lambda k: lo % (1 << k) = 0 AND lo + (1 << k) - 1 <= hi)) FROM win
  UNION SELECT document_id, list_max(list_filter(range(0, t + 1), lambda k: (hi + 1) % (1 << k) = 0 AND hi + 1 - (1 << k) >= lo)), hi >>
 list_max(list_filter(range(0, t + 1), lambda k: (hi + 1) % (1 << k) = 0 AND hi + 1 - (1 << k) >= lo)) FROM win),
 up AS (SELECT document_id, h, level_index >> (h - height) AS li FROM (SELECT *, unnest(range(height, t + 1)) AS h FROM sd
 JOIN win USING (document_id))),
 c AS (SELECT document_id, h, li FROM up UNION SELECT document_id, h, xor(li, 1) FROM up UNION SELECT document_id, height, level_index
 FROM nodes WHERE parent_id IS NULL AND document_id IN (SELECT document_id FROM win)),
 cov AS (SELECT n.* FROM c JOIN win USING (document_id) JOIN nodes n ON n.document_id = c.document_id AND n.height = c.h AND n.level_index = c.li
 WHERE li << h >= lo AND ((li + 1) << h) - 1 <= hi{pin})"""
_WINDOWED = _COVER.format(lo="2", hi="last - 1", some="last >= 3", pin="")
_PINNED = _COVER.format(lo="2", hi="last - 1", some="last >= 3", pin=" AND NOT (h > 0 AND li = hi >> h)")
_WHOLE = _COVER.format(lo="0", hi="last", some="document_id IN (SELECT document_id FROM nodes WHERE height = 0 AND level_index % 5 = 3)", pin="")

simple("r10_r13_windowed_coverage", lambda n: P.windowed_coverage(_seeds(n), n, _windows(n)).select("query_id", "id"), f"{_WINDOWED} SELECT document_id AS query_id, id FROM cov")
simple("r11_complete_coverage", lambda n: P.complete_coverage(_seeds(n), n).select("query_id", "id"), f"{_WHOLE} SELECT document_id AS query_id, id FROM cov")


@query("r10_r20_pinned_coverage", f"{_PINNED} SELECT document_id AS query_id, id FROM cov", nodes=True)
def pinned(spark, d):
    """The last leaf of the window is pinned: its ancestors go, it is a root of its own."""
    n = nodes_of(spark, d)
    w = _windows(n)
    p = w.select("query_id", "document_id", F.lit(0).alias("height"), F.col("hi").alias("level_index"))
    return P.windowed_coverage(_seeds(n), n, w, p).select("query_id", "id")


_VECTORS = """, v AS (SELECT id, CAST(e.embedding AS DOUBLE[]) AS v FROM nodes JOIN embeddings e ON e.vec_id = (document_id * 31 + level_index) % 97 WHERE height = 0),
 q AS (SELECT DISTINCT document_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS qv FROM nodes JOIN embeddings e ON e.vec_id = document_id % 89),
 own AS (SELECT document_id AS query_id, id, parent_id FROM cov WHERE height = 0 AND level_index % 5 = 3),
 asked AS (SELECT query_id, id FROM own UNION SELECT query_id, c.id FROM own JOIN cov c ON c.document_id = query_id AND c.parent_id = own.parent_id),
 seed AS (SELECT query_id, id, greatest(0.0, least(1.0, list_cosine_similarity(v, qv))) AS score FROM asked JOIN v USING (id) JOIN q USING (query_id))"""


def _scored(spark, d):
    n = nodes_of(spark, d)
    cover = P.complete_coverage(_seeds(n), n)
    e = S.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("vec"))
    leaf = n.where("height = 0").select("id", ((F.col("document_id") * 31 + F.col("level_index")) % 97).alias("vec_id"))
    asked = n.select(F.col("document_id").alias("query_id")).distinct().withColumn("vec_id", F.col("query_id") % 89)
    queries = asked.join(e, "vec_id").select("query_id", F.col("vec").alias("qvec"))
    found = n.where(_SEEDS).select(F.col("document_id").alias("query_id"), "id")
    return cover, P.seed_scores(found, cover, leaf.join(e, "vec_id").select("id", "vec"), queries)


@query("r14_r15_seed_scores", f"{_WHOLE}{_VECTORS} SELECT query_id, id, round(score, 9) AS score FROM seed", nodes=True)
def seed_scores(spark, d):
    return _scored(spark, d)[1].withColumn("score", F.round("score", 9))


@query(
    "r14_propagated_scores",
    NODES.replace("WITH s AS", "WITH RECURSIVE s AS") + f"""{_WHOLE}{_VECTORS}, r AS (SELECT document_id, c.id, c.parent_id, CAST(0 AS INT) AS height, s.score FROM cov c LEFT JOIN seed s ON s.query_id = c.document_id AND s.id = c.id WHERE c.height = 0
 UNION ALL SELECT c.document_id, c.id, c.parent_id, CAST(c.height AS INT), coalesce(k.score, 0.0) FROM cov c JOIN (SELECT max(height) + 1 AS h FROM r) ON c.height = h LEFT JOIN (SELECT parent_id, avg(score) AS score FROM r GROUP BY 1) k ON k.parent_id = c.id)
 SELECT document_id AS query_id, id, round(score, 9) AS score FROM r""",
)
def propagated(spark, d):
    cover, seeds = _scored(spark, d)
    return V.propagate(cover, seeds).withColumn("score", F.round("score", 9))


simple("r09_searchable", lambda n: P.searchable(n.where("height = 0"), n.where("height = 0").groupBy("document_id").agg(F.max("span_end").alias("len")).select(F.col("document_id").alias("query_id"), "document_id", F.lit(500).alias("start"), F.lit(3000).alias("end"), (F.col("len") - 700).alias("horizon"))).select("query_id", "id"), """, l AS (SELECT document_id, max(span_end) - 700 AS z FROM nodes GROUP BY 1)
 SELECT document_id AS query_id, id FROM nodes JOIN l USING (document_id) WHERE height = 0 AND span_start < 3000 AND span_end > 500 AND span_end <= z""")
simple("r12_leaf_window", lambda n: P.leaf_window(n.where("height = 1").select("id", F.col("span_start").alias("start"), F.col("span_end").alias("end")).where("start < end"), S.CHUNK).select("id", "lo", "hi"), "SELECT id, span_start // 400 AS lo, (span_end - 1) // 400 AS hi FROM nodes WHERE height = 1 AND span_start < span_end")


@query("r22_r09_requests", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'structure' WHEN event_id % 3 = 0 THEN 'seeds' WHEN event_id % 3 = 1 THEN
 'budget' ELSE 'budget+seeds' END AS mode, CASE WHEN event_id % 3 <> 1 OR event_id % 7 = 0 THEN CAST(floor((CASE WHEN event_id % 7 = 0 THEN 0 ELSE
 event_id % 11 + 1 END) * 2.5) AS BIGINT) END AS k FROM events""")
def requests(spark, d):
    e = F.col("event_id")
    seeds = F.when(e % 7 == 0, 0).when(e % 3 != 1, e % 11 + 1)
    budget = F.when(e % 3 != 0, e * 10)
    return S.read(spark, d, "events").select("event_id", P.request_mode(budget, seeds).alias("mode"), P.candidate_count(seeds, 2.5).alias("k"))


simple("r23_window_errors", lambda n: n.where("parent_id is null").select("id", P.window_error(F.col("span_start"), F.lit(800), F.col("span_end")).alias("error")), "SELECT id, CASE WHEN span_start >= 800 THEN 'window.empty' WHEN span_start >= span_end THEN 'window.outside' END AS error FROM nodes WHERE parent_id IS NULL")
simple("r26_tiling_mass", lambda n: P.tiling_mass(n.where("parent_id is null").select(F.col("document_id").alias("query_id"), "token_count", (1.0 / (1 + F.col("level_index"))).alias("score"))), """SELECT document_id AS query_id, count(*) AS n_nodes, CAST(sum(token_count) AS BIGINT) AS tokens,
 sum(token_count * (1::DOUBLE / (1 + level_index))) AS mass FROM nodes WHERE parent_id IS NULL GROUP BY 1""")
simple("r29_token_positions", P.token_positions, """, l AS (SELECT document_id, level_index, CAST(sum(token_count) OVER (PARTITION BY document_id
 ORDER BY level_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, token_count AS t FROM nodes WHERE height = 0)
 SELECT n.id, a.e - a.t AS token_start, b.e AS token_end FROM nodes n
 JOIN l a ON a.document_id = n.document_id AND a.level_index = n.level_index << n.height
 JOIN l b ON b.document_id = n.document_id AND b.level_index = ((n.level_index + 1) << n.height) - 1""")


@query(
    "w07_verbatim_leaves",
    NODES.replace("WITH s AS", "WITH RECURSIVE s AS") + """, l AS (SELECT document_id, id, token_count, span_start, row_number() OVER (PARTITION BY document_id
 ORDER BY span_end DESC, level_index DESC) AS k FROM nodes WHERE height = 0),
 g AS (SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS k, CAST(260 AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS
 span_start FROM l
 UNION ALL SELECT g.document_id, l.k, CASE WHEN token_count <= room THEN room - token_count ELSE room END, CASE WHEN token_count <= room THEN l.id
 END, CASE WHEN token_count <= room THEN l.span_start END FROM g JOIN l ON l.document_id = g.document_id AND l.k = g.k + 1)
 SELECT document_id, min(span_start) OVER (PARTITION BY document_id) AS horizon, id FROM g WHERE id IS NOT NULL""",
)
def verbatim(spark, d):
    return P.verbatim_leaves(nodes_of(spark, d).where("height = 0"), 260)


@query(
    "r07_mmr_two",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, e.v, greatest(0.0,
 least(1.0, list_cosine_similarity(q.v, e.v))) AS rel FROM e, e q WHERE q.vec_id % 50 = 0),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, vec_id) AS rank FROM s
 QUALIFY rank <= 20), f AS (SELECT query_id, vec_id, v FROM c WHERE rank = 1),
 n AS (SELECT c.query_id, c.vec_id, row_number() OVER (PARTITION BY c.query_id
 ORDER BY 0.7 * rel - 0.3 * greatest(0.0, least(1.0, list_cosine_similarity(c.v, f.v))) DESC, rank) AS k FROM c JOIN f USING (query_id)
 WHERE c.vec_id <> f.vec_id QUALIFY k = 1)
 SELECT query_id, vec_id, 1 AS position FROM f UNION ALL SELECT query_id, vec_id, 2 FROM n""",
)
def mmr_two(spark, d):
    e = S.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("vec"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return V.mmr(V.vector_top_k(q, e, 20).join(e.select("vec_id", "vec"), "vec_id"), 2)


# building


@query("b04_join_lines", r"""SELECT doc_id, md5(replace(regexp_replace(replace(text, chr(10) || chr(10), chr(57344)), '([^.!?\n])\n', '\1 ', 'g'), chr(57344), chr(10) || chr(10))) AS digest FROM documents""")
def join_lines(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(B.join_lines(F.col("text")).cast("binary")).alias("digest"))


@query("b09_parse_units", """SELECT event_id, epoch_us(date_trunc('second', ts)) / 1e6 AS time_start, epoch_us(date_trunc('second', ts)) / 1e6 +
 event_id % 60 AS time_end FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 0""")
def parse_units(spark, d):
    t = F.col("ts").cast("timestamp")
    iso = lambda x: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    some = F.col("event_id") % 4 != 0
    u = S.read(spark, d, "events").select("event_id", F.when(some, iso(t)).alias("time_start"), F.when(some, iso(F.timestamp_add("SECOND", F.col("event_id") % 60, t))).alias("time_end"))
    return B.parse_units(u)


_UNITS = """WITH u AS (SELECT conv_id AS document_id, row_number() OVER w - 1 AS level_index, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS
 span_start, CAST(sum(length(text)) OVER w AS BIGINT) AS span_end, turn * 60.0 AS time_start, turn * 60.0 + 30 AS time_end
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def _units(spark, d):
    c = S.read(spark, d, "conversations")
    t = F.col("turn") * 60.0
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("unit_no"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), t.alias("time_start"), (t + 30).alias("time_end"))


_NO_LEAVES = "document_id bigint, level_index bigint, span_start bigint, span_end bigint, token_count bigint, time_start double, time_end double"


@query("b07_append", f"{_UNITS} SELECT document_id, level_index, span_start, span_end, time_start, time_end FROM u")
def append(spark, d):
    """Turns 0 to 3 first, the others after them: the same leaves as all at once."""
    u = _units(spark, d)
    first = B.append(spark.createDataFrame([], _NO_LEAVES), u.where("unit_no < 4"))
    return first.unionByName(B.append(first, u.where("unit_no >= 4"))).drop("token_count")


_PARENTS = f"{_UNITS}, p AS (SELECT document_id, h AS height, level_index >> h AS level_index, min(span_start) AS span_start, max(span_end) AS span_end, min(time_start) AS time_start, max(time_end) AS time_end FROM u, unnest(range(0, 12)) r(h) GROUP BY ALL HAVING count(*) = 1 << h)"
_NODE = "document_id, CAST(height AS INT) AS height, level_index, span_start, span_end, time_start, time_end"


@query("b11_parents", f"{_PARENTS} SELECT {_NODE} FROM p WHERE height > 0")
def parents(spark, d):
    leaves = B.append(spark.createDataFrame([], _NO_LEAVES), _units(spark, d))
    return B.parents(leaves).drop("token_count")


@query("st01_incremental_build", f"{_PARENTS} SELECT {_NODE} FROM p")
def incremental(spark, d):
    """Turns 0 and 1, 2 to 4 and the rest arrive as files; each batch adds its leaves and what they complete."""
    u, source = _units(spark, d), scratch(spark, "units")
    for part in ("unit_no < 2", "unit_no between 2 and 4", "unit_no > 4"):
        u.where(part).repartition("document_id").write.mode("append").json(f"{source}/{uuid.uuid4().hex}")
    return builder.build(spark, f"{source}/*", scratch(spark, "tree")).drop("token_count", "batch")


_CONTEXT = """SELECT doc_id, substring(text, 1, 400) AS leaf, substring(text, 401, 900) AS ctx, length(substring(text, 1, 400)) // 4 AS lt,
 length(substring(text, 401, 900)) // 4 AS ct, 200 - length(substring(text, 1, 400)) // 4 - 1 AS room FROM documents"""


@query(
    "b15_b21_embedding_text",
    f"WITH x AS ({_CONTEXT}), y AS (SELECT *, CASE WHEN ct <= room THEN ctx ELSE substring(ctx, CAST(greatest(1, length(ctx) - room * 4 + 1) AS BIGINT), room * 4) END AS cut FROM x) SELECT doc_id, md5(CASE WHEN room <= 0 OR trim(cut, ' ') = '' THEN leaf ELSE cut || chr(10) || leaf END) AS digest FROM y",
)
def embedding_text(spark, d):
    leaf, ctx = F.substring("text", 1, 400), F.substring("text", 401, 900)
    n = lambda c: F.floor(F.length(c) / 4)
    return S.read(spark, d, "documents").select("doc_id", F.md5(B.embedding_text(ctx, n(ctx), leaf, n(leaf), 200).cast("binary")).alias("digest"))


@query(
    "b16_batches",
    NODES.replace("WITH s AS", "WITH RECURSIVE s AS") + """, l AS (SELECT document_id, level_index AS k, token_count AS t FROM nodes WHERE height = 0),
 g AS (SELECT document_id, k, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, t FROM l WHERE k = 0
 UNION ALL SELECT l.document_id, l.k, CASE WHEN g.n >= 8 OR g.t + l.t > 750 THEN b + 1 ELSE b END, CASE WHEN g.n >= 8 OR g.t + l.t > 750 THEN 1 ELSE
 g.n + 1 END, CASE WHEN g.n >= 8 OR g.t + l.t > 750 THEN l.t ELSE g.t + l.t END FROM g JOIN l ON l.document_id = g.document_id AND l.k = g.k + 1)
 SELECT document_id, k AS level_index, b AS batch FROM g""",
)
def batches(spark, d):
    leaves = nodes_of(spark, d).where("height = 0").select("document_id", "level_index", "token_count")
    return B.batches(leaves, "document_id", "level_index", "token_count", 8, 750).select("document_id", "level_index", F.col("batch").cast("bigint").alias("batch"))


@query("b14_best_attempts", """WITH a AS (SELECT event_id // 3 AS node_id, event_id % 3 AS attempt, (event_id // 3 % 7 + 2) * 25 AS target, (event_id //
 3 % 7 + 2) * 25 + event_id * 13 % 61 - 30 AS actual FROM events) SELECT node_id, arg_max(attempt, (actual <= target, CASE WHEN actual <= target THEN
 actual ELSE -actual END, -attempt)) AS attempt, round(max(target) * 0.75::DOUBLE * 0.94::DOUBLE)::BIGINT AS words FROM a GROUP BY 1""")
def best_attempts(spark, d):
    a = S.attempts(S.read(spark, d, "events"))
    return B.best_attempt(a).join(a.groupBy("node_id").agg(F.max("target_tokens").alias("t")), "node_id").select("node_id", "attempt", B.words_for(F.col("t")).alias("words"))


_SYNC = """WITH i AS (SELECT user_id AS session, event_id AS uuid, ts FROM events
 WHERE event_id % 3 <> 0 AND day(ts) < 20), g AS (SELECT user_id AS session, event_id AS uuid, ts FROM events WHERE event_id % 41 <> 0),
 cut AS (SELECT session, min(ts) AS c FROM i WHERE uuid NOT IN (SELECT uuid FROM g)
 GROUP BY 1), x AS (SELECT i.*, CASE WHEN i.ts >= c THEN 'delete' ELSE 'keep' END AS action FROM i LEFT JOIN cut USING (session)),
 m AS (SELECT session, max(ts) AS m FROM x WHERE action = 'keep' GROUP BY 1)
 SELECT session, uuid, action FROM x UNION ALL SELECT g.session, g.uuid, CASE WHEN m IS NULL OR g.ts > m THEN 'append' ELSE 'late' END FROM g
 LEFT JOIN m USING (session) WHERE uuid NOT IN (SELECT uuid FROM x WHERE action = 'keep')"""


@query("st13_st14_sync_actions", _SYNC)
def sync(spark, d):
    e = S.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("uuid"), "ts")
    return B.sync_actions(e.where("uuid % 3 <> 0 and day(ts) < 20"), e.where("uuid % 41 <> 0"))


_SYNCED = """WITH e AS (SELECT user_id AS session, event_id AS uuid, ts FROM events), m AS (SELECT session, max(ts) AS m FROM e WHERE uuid % 3 = 0
 GROUP BY 1),
 b AS (SELECT session, uuid, ts FROM e LEFT JOIN m USING (session) WHERE uuid % 3 = 0 OR (uuid % 3 = 1 AND (m IS NULL OR ts > m))), c AS (SELECT
 session, min(ts) AS c FROM b WHERE uuid % 21 = 0 GROUP BY 1),
 k AS (SELECT b.* FROM b LEFT JOIN c USING (session) WHERE c IS NULL OR b.ts < c), n AS (SELECT session, max(ts) AS n FROM k GROUP BY 1)
 SELECT session, uuid FROM k UNION SELECT e.session, uuid FROM e LEFT JOIN n USING (session)
 WHERE uuid % 3 <> 2 AND uuid % 21 <> 0 AND (n IS NULL OR ts > n)"""


@query("st13_st14_sync_stream", _SYNCED)
def sync_stream(spark, d):
    """Three batches: a third of the records; another third, of which those not later stay out; then reverts of some of the first."""
    return _three_batches(spark, d, sync_log)


@query("st13_st14_sync_buckets", _SYNCED)
def sync_buckets(spark, d):
    """The same batches, each of which reads and writes the buckets of its sessions only."""
    return _three_batches(spark, d, sync_by_bucket)


def _three_batches(spark, d, sync):
    """The index after three appends to a log, each taken in as one batch, however many files it has."""
    e, source, path = F.col("uuid"), scratch(spark, "log"), scratch(spark, "sync")
    x = S.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("uuid"), F.col("ts").cast("timestamp").alias("ts"))
    for part, removed in ((e % 3 == 0, False), (e % 3 == 1, False), (e % 21 == 0, True)):
        x.where(part).withColumn("removed", F.lit(removed)).write.json(f"{source}/{uuid.uuid4().hex}")
        got = sync(spark, f"{source}/*", path, files=None)
    return got.select("session", "uuid")
