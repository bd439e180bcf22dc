"""Queries of telemetry, evaluation and transcripts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import evaluation as E
from arbor.operators import telemetry as T
from arbor.plans.base import REC, query
from arbor.sources import corpus as S

ATTEMPTS = """WITH a AS (SELECT event_id // 3 AS node_id, event_id % 3 AS attempt, event_id // 3 % 4 AS accepted, event_id // 3 % 5 + event_id // 3 % 2
 AS height, (event_id // 3 % 7 + 2) * 25 AS target_tokens, (event_id // 3 % 7 + 2) * 25 + event_id * 13 % 61 - 30 AS actual_tokens, (event_id // 3 %
 7 + 2) * 25 + event_id * 13 % 61 - 30 + event_id % 4 AS prompt_tokens, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE event_id END AS start_time,
 event_id + 1 + event_id % 9 AS end_time FROM events), acc AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY node_id
 ORDER BY (attempt = accepted) DESC, attempt DESC) = 1) """


def _attempts(spark, d):
    return S.attempts(S.read(spark, d, "events"))


def _events(spark, d):
    return S.read(spark, d, "events")


@query("m01_accepted_attempt", ATTEMPTS + "SELECT node_id, attempt, actual_tokens FROM acc")
def accepted(spark, d):
    return E.accepted_attempts(_attempts(spark, d)).select("node_id", "attempt", "actual_tokens")


@query("m02_target_groups", ATTEMPTS + """, x AS (SELECT *, (actual_tokens - target_tokens) / CAST(target_tokens AS DOUBLE) * 100 AS d FROM a
 WHERE attempt = accepted) SELECT target_tokens, count(*) AS n, avg(d) AS mean, median(d) AS median, avg(abs(d)) AS mean_abs, greatest(0.0, max(d))
 AS overshoot, greatest(0.0, max(-d)) AS undershoot, avg(CAST(abs(d) <= 5 AS INT)) AS within_5, avg(CAST(abs(d) <= 10 AS INT)) AS within_10,
 avg(CAST(abs(d) <= 20 AS INT)) AS within_20, avg(CAST(abs(d) <= 50 AS INT)) AS within_50 FROM x GROUP BY 1""")
def target_groups(spark, d):
    return E.target_groups(_attempts(spark, d))


@query("m04_m12_retries", "SELECT least(n - 1, 3) AS retries, count(*) AS n_nodes FROM (SELECT event_id // 3 AS k, count(*) AS n FROM events WHERE event_id % 7 <> 1 GROUP BY 1) GROUP BY 1")
def retries(spark, d):
    return E.retries(S.attempts(_events(spark, d).where("event_id % 7 <> 1")))


@query("m05_latencies", ATTEMPTS + "SELECT node_id, CAST(max(end_time) - min(start_time) FILTER (start_time > 0) AS DOUBLE) AS latency FROM a GROUP BY 1 HAVING count(*) FILTER (start_time > 0) > 0")
def latencies(spark, d):
    return E.latencies(_attempts(spark, d))


@query("m10_verbatim", ATTEMPTS + "SELECT height, count(*) AS n, count(*) FILTER (abs(actual_tokens / CAST(prompt_tokens AS DOUBLE) - 1) <= 0.02) AS verbatim FROM acc WHERE prompt_tokens > 0 GROUP BY 1")
def verbatim(spark, d):
    return E.verbatim_by_height(E.accepted_attempts(_attempts(spark, d)))


@query("m13_nodes_per_height", ATTEMPTS + """SELECT CAST(h AS INT) AS height, count(node_id) AS n FROM (SELECT unnest(range(0, (SELECT max(height)
 FROM acc) + 1)) AS h) LEFT JOIN (SELECT * FROM acc WHERE height <> 2) ON height = h GROUP BY 1""")
def per_height(spark, d):
    return E.per_height(E.accepted_attempts(_attempts(spark, d)).where("height <> 2"))


_DEV = "avg(value - 100) AS mean, median(value - 100) AS median, avg(abs(value - 100)) AS mean_abs, stddev_pop(value - 100) AS pstd, avg(CAST(abs(value - 100) <= 10 AS INT)) AS within_10, avg(CAST(abs(value - 100) <= 20 AS INT)) AS within_20, 100 / (100 + avg(value - 100)) AS compensation"


@query("m27_m28_m31_strategies", f"SELECT event_type, event_id % 3 AS ratio, count(*) AS n, {_DEV} FROM events GROUP BY 1, 2")
def strategies(spark, d):
    e = _events(spark, d).withColumn("deviation", F.col("value") - 100).withColumn("ratio", F.col("event_id") % 3)
    return E.strategies(e, ["event_type", "ratio"])


@query("m29_size_buckets", f"SELECT event_type, CASE WHEN event_id < 250 THEN '<250' WHEN event_id < 450 THEN '<450' WHEN event_id < 750 THEN '<750' WHEN event_id < 1200 THEN '<1200' ELSE '1200+' END AS bucket, count(*) AS n, {_DEV} FROM events GROUP BY 1, 2")
def size_buckets(spark, d):
    e = _events(spark, d).withColumn("deviation", F.col("value") - 100).withColumn("bucket", E.size_bucket("event_id"))
    return E.strategies(e, ["event_type", "bucket"])


@query("m32_pivot", """SELECT event_id % 4 AS ratio, avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'signup')
 AS signup, avg(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def pivot(spark, d):
    return E.pivot_mean(_events(spark, d).withColumn("ratio", F.col("event_id") % 4), "ratio", "event_type", ["purchase", "signup", "error"], "value")


@query("m34_histogram", "SELECT CAST(floor(value / 25) * 25 AS DOUBLE) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return E.histogram(_events(spark, d), "value", 25.0)


@query("j17_m15_compare", """WITH b AS (SELECT user_id, avg(value) AS was FROM events WHERE event_id % 2 = 0
 GROUP BY 1), c AS (SELECT user_id, avg(value) AS now FROM events WHERE event_id % 2 = 1 GROUP BY 1)
 SELECT user_id, was, now, (now - was) / was AS change, coalesce((now - was) / was > 0.5, false) AS regressed FROM b JOIN c USING (user_id)""")
def compare(spark, d):
    half = lambda k: _events(spark, d).where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.avg("value").alias("v"))
    return E.compare(half(0), half(1), "user_id", "v")


@query("m16_gate", ATTEMPTS + """, m AS (SELECT avg(abs(actual_tokens - target_tokens) / CAST(target_tokens AS DOUBLE)) * 100 AS deviation,
 avg(CAST(actual_tokens > target_tokens AS INT)) * 100 AS oversized, median(end_time - start_time) AS seconds FROM acc) SELECT *
 FROM (SELECT 'deviation' AS metric, deviation AS value, CAST(14 AS DOUBLE) AS bound FROM m UNION ALL SELECT 'oversized', oversized, 9.0 FROM m
 UNION ALL SELECT 'seconds', seconds, 3.0 FROM m) WHERE value > bound""")
def gate(spark, d):
    off = F.abs(F.col("actual_tokens") - F.col("target_tokens")) / F.col("target_tokens")
    m = E.accepted_attempts(_attempts(spark, d)).agg((F.avg(off) * 100).alias("deviation"), (F.avg((F.col("actual_tokens") > F.col("target_tokens")).cast("double")) * 100).alias("oversized"), F.median(F.col("end_time") - F.col("start_time")).alias("seconds"))
    return E.gate(m, {"deviation": 14, "oversized": 9, "seconds": 3})


@query("a19_accuracy", "SELECT event_type AS category, count(*) AS n, avg(CAST(event_id % 3 = 0 AS INT)) AS accuracy, avg(value / 1000) AS f1 FROM events GROUP BY ROLLUP (event_type)")
def accuracy(spark, d):
    v = _events(spark, d).select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 3 == 0, "A").otherwise("C").alias("verdict"), (F.col("value") / 1000).alias("f1"))
    return E.accuracy(v)


@query("a20_report", """WITH e AS (SELECT event_id % 5 + 1 AS retention, event_id % 4 + 1 AS isolation, event_id * 7 % 5 + 1 AS continuity
 FROM events), l AS (SELECT (retention + isolation + continuity) / 3.0 AS m, unnest(['retention', 'isolation', 'continuity']) AS dimension,
 unnest([retention, isolation, continuity]) AS score FROM e) SELECT dimension, avg(score) AS mean, stddev_samp(score) AS std, CAST(min(score) AS
 DOUBLE) AS least, count(*) FILTER (score <= 2) AS outliers, count(*) FILTER (m < 2.5) AS failures FROM l GROUP BY 1""")
def report(spark, d):
    k = F.col("event_id")
    s = _events(spark, d).select((k % 5 + 1).alias("retention"), (k % 4 + 1).alias("isolation"), (k * 7 % 5 + 1).alias("continuity"))
    return E.evaluation_report(s, ["retention", "isolation", "continuity"])


@query("j15_j16_merge", """WITH c AS (SELECT user_id, max(event_id) AS last, min(event_type) AS kind FROM events WHERE event_id % 3 = 0
 GROUP BY 1), a AS (SELECT user_id, max(event_id) AS last, min(CASE WHEN event_id % 2 = 0 THEN event_type END) AS kind FROM events
 WHERE event_id % 3 = 1 GROUP BY 1) SELECT user_id, coalesce(a.last, c.last) AS last, coalesce(a.kind, c.kind) AS kind FROM c FULL
 JOIN a USING (user_id)""")
def merge(spark, d):
    e = _events(spark, d)
    c = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("last"), F.min("event_type").alias("kind"))
    a = e.where("event_id % 3 = 1").groupBy("user_id").agg(F.max("event_id").alias("last"), F.min(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("kind"))
    return E.merged(c, a, "user_id", ["last", "kind"])


_CHAIN = REC.replace("WITH r", "WITH RECURSIVE r") + ", b AS (SELECT r.session, r.uuid, coalesce(r.parent, prev) AS parent, line, ts FROM r JOIN (SELECT event_id AS uuid, ts FROM events) USING (uuid)), "


@query("g03_common_ancestor", _CHAIN + """h AS (SELECT session, max_by(uuid, line) AS x, max_by(uuid, line) FILTER (line % 2 = 1) AS y FROM b
 GROUP BY 1), c AS (SELECT session, x AS uuid, 0 AS depth, 'x' AS s FROM h UNION ALL SELECT session, y, 0, 'y' FROM h UNION ALL
 SELECT b.session, b.parent, depth + 1, s FROM c JOIN b ON b.session = c.session AND b.uuid = c.uuid WHERE b.parent IS NOT NULL)
 SELECT p.session, min_by(p.uuid, p.depth) AS uuid, CAST(min(p.depth) AS BIGINT) AS depth_a, CAST(min_by(q.depth, p.depth) AS BIGINT) AS depth_b
 FROM c p JOIN c q ON p.session = q.session AND p.uuid = q.uuid AND p.s = 'x' AND q.s = 'y' GROUP BY 1""")
def common_ancestor(spark, d):
    r = T.bridge(S.transcript(_events(spark, d)))
    odd = r.where("line % 2 = 1").groupBy("session").agg(F.max_by("uuid", "line").alias("uuid"))
    return T.common_ancestor(T.chain(r), T.chain(r, starts=odd))


@query("g04_g05_g07_sync_plan", _CHAIN + """h AS (SELECT session, max_by(uuid, line) AS uuid, max_by(ts, line) FILTER (line % 3 = 1) AS cutoff
 FROM b GROUP BY 1), c AS (SELECT session, uuid, 0 AS depth FROM h UNION ALL SELECT b.session, b.parent, depth + 1 FROM c
 JOIN b ON b.session = c.session AND b.uuid = c.uuid WHERE b.parent IS NOT NULL), x AS (SELECT c.*, ts, cutoff FROM c
 JOIN b USING (session, uuid) JOIN (SELECT session, cutoff FROM h) USING (session))
 SELECT session, arg_min(uuid, depth) FILTER (ts <= cutoff) AS truncate_at, CAST(coalesce(min(depth) FILTER (ts <= cutoff), count(*)) AS BIGINT) AS
 n_new, CASE WHEN count(*) FILTER (ts <= cutoff) = 0 THEN 'full' WHEN max(ts) FILTER (ts <= cutoff) = max(cutoff) THEN 'none' ELSE 'partial' END AS
 kind FROM x GROUP BY 1""")
def sync_plan(spark, d):
    r = T.bridge(S.transcript(_events(spark, d)))
    cut = r.where("line % 3 = 1").groupBy("session").agg(F.max_by("ts", "line").alias("cutoff"))
    return T.sync_plan(T.chain(r), r, cut)


@query("t05_recent_queries", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent(spark, d):
    return _events(spark, d).orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")


@query("t09_worst", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 5")
def worst(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return _events(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_type", "event_id", "value")


@query("a18_first_occurrence", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_occurrence(spark, d):
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
