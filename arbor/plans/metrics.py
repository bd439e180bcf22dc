"""Queries of telemetry metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import metrics as M
from arbor.operators import telemetry as T
from arbor.plans.base import REC, query, simple
from arbor.sources import corpus as S

_FID = "SELECT user_id AS document_id, event_id AS node_id, (event_id * 37 % 101) / 101.0::DOUBLE AS fidelity FROM events WHERE event_id % 6 <> 0"


def _events(spark, d):
    return S.read(spark, d, "events")


def _fidelities(spark, d):
    e = F.col("event_id")
    return _events(spark, d).select(F.col("user_id").alias("document_id"), e.alias("node_id"), F.when(e % 6 != 0, (e * 37 % 101) / 101.0).alias("fidelity"))


@query("m08_fidelity", f"SELECT document_id, count(*) AS n, avg(fidelity) AS mean, median(fidelity) AS median, min(fidelity) AS least, max(fidelity) AS most, stddev_pop(fidelity) AS pstd FROM ({_FID}) GROUP BY 1")
def fidelity(spark, d):
    return M.fidelity(_fidelities(spark, d))[0]


@query("m08_t09_worst_nodes", f"SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY fidelity, node_id) AS rank FROM ({_FID}) QUALIFY rank <= 5")
def worst(spark, d):
    return M.fidelity(_fidelities(spark, d))[1].select("document_id", "node_id", F.col("rank").cast("bigint").alias("rank"))


_OPS = """SELECT user_id AS run, CASE WHEN event_id % 2 = 0 THEN 'embed' ELSE 'summary ' || event_id END AS op, CASE WHEN event_id % 13 = 0 THEN 0 ELSE
 event_id // 8 * 8 END::DOUBLE AS s, (event_id // 8 * 8 + 1 + event_id % 2 * (event_id % 5))::DOUBLE AS e FROM events"""


@query("m09_pipeline_efficiency", f"WITH o AS ({_OPS}), x AS (SELECT DISTINCT * FROM o WHERE s > 0 AND e > s), a AS (SELECT run, sum(e - s) AS t, max(e - s) AS l, max(e) - min(s) AS w FROM x GROUP BY 1) SELECT run, coalesce(greatest(0, least(100, CASE WHEN t <= l THEN 100 ELSE (t - w) / (t - l) * 100 END)), 0)::DOUBLE AS efficiency FROM (SELECT DISTINCT run FROM o) LEFT JOIN a USING (run)")
def efficiency(spark, d):
    e = F.col("event_id")
    at = F.floor(e / 8) * 8
    return M.pipeline_efficiency(_events(spark, d).select(F.col("user_id").alias("run"), F.when(e % 2 == 0, "embed").otherwise(F.concat(F.lit("summary "), e.cast("string"))).alias("op"), F.when(e % 13 == 0, 0).otherwise(at).cast("double").alias("start"), (at + 1 + e % 2 * (e % 5)).cast("double").alias("end")))


_EMB = "SELECT user_id AS run, event_id % 4 + 1 AS batch_size, event_id // 40 AS start FROM events"


def _embeddings(spark, d):
    e = F.col("event_id")
    return _events(spark, d).select(F.col("user_id").alias("run"), (e % 4 + 1).alias("batch_size"), F.floor(e / 40).alias("start"))


@query("m11_batch_efficiency", f"WITH x AS ({_EMB}), b AS (SELECT DISTINCT * FROM x) SELECT run, count(*) AS n_batches, avg(batch_size) AS mean_size, max(batch_size) AS largest, CAST(sum(batch_size - 1) AS BIGINT) AS batched, count(*) FILTER (batch_size = 1) AS single, max(n_embeddings) AS n_embeddings, sum(batch_size - 1) * 100.0::DOUBLE / max(n_embeddings) AS utilisation FROM b JOIN (SELECT run, count(*) AS n_embeddings FROM x GROUP BY 1) USING (run) GROUP BY 1")
def batch_efficiency(spark, d):
    return M.batch_efficiency(_embeddings(spark, d))


@query("m11_batch_sizes", f"SELECT run, batch_size, count(*) AS n FROM (SELECT DISTINCT * FROM ({_EMB})) GROUP BY 1, 2")
def batch_sizes(spark, d):
    return M.batch_sizes(_embeddings(spark, d))


_PHASES = list(M.PHASE_FACTORS)
_TIMES = f"SELECT {_PHASES}[event_id % 8 + 1] AS phase, value AS seconds, event_id FROM events"


def _timings(spark, d):
    return _events(spark, d).select(F.element_at(F.array(*[F.lit(p) for p in _PHASES]), (F.col("event_id") % 8 + 1).cast("int")).alias("phase"), F.col("value").alias("seconds"), "event_id")


def _stats_sql(where: str) -> str:
    return f"""t AS (SELECT * FROM ({_TIMES}) WHERE seconds IS NOT NULL AND {where}), r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM t), md AS (SELECT phase, median(seconds) AS median FROM t GROUP BY 1),
 st AS (SELECT phase, median, (SELECT median(abs(t.seconds - md.median)) FROM t WHERE t.phase = md.phase) AS mad, max(seconds) FILTER (i = least(n - 1, floor(n * 0.5))) AS p50, max(seconds) FILTER (i = least(n - 1, floor(n * 0.95))) AS p95, max(seconds) FILTER (i = least(n - 1, floor(n * 0.99))) AS p99 FROM md JOIN r USING (phase) GROUP BY ALL)"""


@query("m14_phase_statistics", f"WITH {_stats_sql('true')} SELECT * FROM st")
def phase_statistics(spark, d):
    return M.phase_statistics(_timings(spark, d))


_K = "CASE WHEN phase IN ('tiling_time', 'scoring_time', 'assembly_time') THEN 6.0 WHEN phase IN ('search_time', 'mmr_time', 'coverage_map_time') THEN 4.0 ELSE 5.0 END::DOUBLE"


@query("m17_phase_thresholds", f"WITH {_stats_sql('true')} SELECT phase, CASE WHEN mad > 0 THEN {_K} * mad END AS threshold FROM st")
def phase_thresholds(spark, d):
    return M.phase_thresholds(M.phase_statistics(_timings(spark, d)))


@query("m18_phase_regressions", f"WITH {_stats_sql('event_id // 8 % 2 = 0')}, m2 AS (SELECT phase, median(seconds * 3) AS now FROM ({_TIMES}) WHERE event_id // 8 % 2 = 1 GROUP BY 1) SELECT phase, median AS was, now, CASE WHEN mad > 0 THEN {_K} * mad END AS threshold, coalesce(now - median > CASE WHEN mad > 0 THEN {_K} * mad END, false) AS regressed FROM st JOIN m2 USING (phase)")
def phase_regressions(spark, d):
    t = _timings(spark, d)
    half = F.floor(F.col("event_id") / 8) % 2
    now = t.where(half == 1).withColumn("seconds", F.col("seconds") * 3)
    return M.phase_regressions(M.phase_statistics(t.where(half == 0)), M.phase_statistics(now)).select("phase", "was", "now", "threshold", "regressed")


@query("m18_consolidated_runs", """WITH r AS (SELECT user_id AS run, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2)
 SELECT metric, count(*) AS n, avg(value) AS mean, min(value) AS least, arg_min(run, (value, run)) AS least_run, max(value) AS most, arg_max(run,
 (value, run)) AS most_run FROM r GROUP BY 1""")
def consolidated(spark, d):
    r = _events(spark, d).groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return M.consolidated(r)


_RUNS = """SELECT user_id AS run, (user_id % 30)::DOUBLE AS size_deviation, (user_id % 17)::DOUBLE AS oversized, user_id % 50 / 10.0::DOUBLE AS
 seconds_per_node, user_id % 21 / 10.0::DOUBLE AS dollars_per_million, (80 + user_id % 21)::DOUBLE AS pipeline_efficiency, (85 + user_id %
 16)::DOUBLE AS fidelity FROM (SELECT DISTINCT user_id FROM events)"""


@query("m16_gate", f"WITH r AS ({_RUNS}) SELECT run, metric, value, bound FROM (SELECT run, unnest([('size_deviation', size_deviation, 14.0, 1), ('oversized', oversized, 9.0, 1), ('seconds_per_node', seconds_per_node, 3.0, 1), ('dollars_per_million', dollars_per_million, 1.0, 1), ('pipeline_efficiency', pipeline_efficiency, 94.0, -1), ('fidelity', fidelity, 90.0, -1)]) AS x FROM r), LATERAL (SELECT x[1] AS metric, x[2] AS value, x[3]::DOUBLE AS bound, x[4] AS way) WHERE (value - bound) * way > 0")
def gate(spark, d):
    u = F.col("run")
    r = _events(spark, d).select(F.col("user_id").alias("run")).distinct()
    return M.gate(r.select("run", (u % 30).alias("size_deviation"), (u % 17).alias("oversized"), (u % 50 / 10.0).alias("seconds_per_node"), (u % 21 / 10.0).alias("dollars_per_million"), (80 + u % 21).alias("pipeline_efficiency"), (85 + u % 16).alias("fidelity")))


_LETTERS = "[" + ", ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{chr(c)}', '')))::DOUBLE" for c in range(97, 123)) + "]"


@query("m19_node_fidelity", f"""WITH c AS (SELECT conv_id, turn, text FROM conversations), j AS (SELECT a.conv_id || ':' || a.turn AS id, a.text AS p, b.text || chr(10) || d.text AS k FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN c d ON d.conv_id = a.conv_id AND d.turn = a.turn + 2),
 v AS (SELECT id, {_LETTERS.format("p")} AS a, {_LETTERS.format("k")} AS b FROM j) SELECT id, CASE WHEN list_dot_product(a, a) * list_dot_product(b, b) > 0 THEN round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 9) END AS fidelity FROM v""")
def node_fidelity(spark, d):
    """Each turn against the two after it, as a node against its children."""
    at = lambda k: F.concat_ws(":", "conv_id", F.col("turn") + k)
    n = S.read(spark, d, "conversations").select(at(0).alias("id"), "text", at(1).alias("left_child_id"), at(2).alias("right_child_id"))
    return M.node_fidelity(n, n.select("id", "text")).withColumn("fidelity", F.round("fidelity", 9))


@query("m23_m25_call_costs", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (event_id % 900 / 1000.0::DOUBLE) * i + (event_id % 70 /
 1000.0::DOUBLE) * i * 1.25::DOUBLE + (event_id % 500 / 1000.0::DOUBLE) * i * (1 - dis) + (event_id % 90 / 1000.0::DOUBLE) * o END AS cost
 FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.25::DOUBLE ELSE 2.0::DOUBLE END AS i, CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE ELSE
 8.0::DOUBLE END AS o, CASE event_id % 3 WHEN 0 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS dis FROM events)""")
def call_costs(spark, d):
    models = spark.createDataFrame([("small", 0.25, 1.0, 0.9, 1.25), ("large", 2.0, 8.0, 0.75, 1.25)], "model string, input double, output double, cache_discount double, write_multiplier double")
    e = F.col("event_id")
    usage = _events(spark, d).select("event_id", F.when(e % 3 == 0, "small").when(e % 3 == 1, "large").otherwise("unknown").alias("model"), (e % 900).alias("input_tokens"), (e % 70).alias("cache_creation_tokens"), (e % 500).alias("cache_read_tokens"), (e % 90).alias("output_tokens"))
    return M.call_costs(usage, models).select("event_id", "cost")


simple("m06_cost_per_million", lambda n: M.cost_per_million(n.select("document_id", (F.col("token_count") * 0.5).alias("cost")), n.where("height = 0").groupBy("document_id").agg(F.sum("token_count").alias("source_tokens"))), """SELECT document_id, sum(token_count * 0.5::DOUBLE) AS cost, CAST(sum(token_count) FILTER (height = 0) AS
 BIGINT) AS source_tokens, CASE WHEN sum(token_count) FILTER (height = 0) > 0 THEN sum(token_count * 0.5::DOUBLE) / sum(token_count) FILTER (height =
 0) * 1000000 END AS per_million FROM nodes GROUP BY 1""")
simple("m26_divergences", lambda n: M.divergences(n, n.where("level_index % 3 <> 1"), 60, 7).select("id", "divergence", "divergence_pct", "left_child_tokens", "right_child_tokens", "preceding_neighbor_tokens"), """, xx AS (SELECT *, token_count - 60 AS divergence, (token_count - 60) * 100.0::DOUBLE / 60 AS divergence_pct,
 row_number() OVER (PARTITION BY document_id ORDER BY abs(token_count - 60) DESC, id) AS r FROM nodes WHERE left_child_id IS NOT NULL QUALIFY r <= 7)
 SELECT xx.id, divergence, divergence_pct, l.token_count AS left_child_tokens, r.token_count AS right_child_tokens, p.token_count AS
 preceding_neighbor_tokens FROM xx JOIN nodes l ON xx.left_child_id = l.id JOIN nodes r ON xx.right_child_id = r.id LEFT
 JOIN nodes p ON xx.preceding_neighbor_id = p.id WHERE xx.level_index % 3 <> 1""")


@query("m30_round_ratios", """WITH r AS (SELECT event_id % 40 / 40.0::DOUBLE AS ratio, value - 100 AS e FROM events)
 SELECT CASE WHEN round(ratio * 10, 6) IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 'round' ELSE 'other' END AS kind, count(*) AS n, avg(abs(e)) AS mean_abs,
 median(abs(e)) AS median_abs, avg((abs(e) <= 10)::INT) * 100 AS within_10, avg((abs(e) <= 20)::INT) * 100 AS within_20 FROM r GROUP BY 1""")
def round_ratios(spark, d):
    return M.round_ratios(_events(spark, d).select((F.col("event_id") % 40 / 40.0).alias("ratio"), (F.col("value") - 100).alias("error_pct")))


@query("m33_timeline", """WITH a AS (SELECT event_id // 3 AS node_id, event_id % 3 AS attempt, event_id // 3 % 5 + event_id // 3 % 2 AS height,
 event_id::DOUBLE AS s, (event_id + 1 + event_id % 9)::DOUBLE AS e FROM events WHERE event_id % 11 <> 0 AND event_id > 0)
 SELECT node_id, attempt, height, s - (SELECT min(s) FROM a) AS \"from\", e - (SELECT min(s) FROM a) AS upto FROM a""")
def timeline(spark, d):
    return M.timeline(S.attempts(_events(spark, d)))


simple("m33_level_usage", M.level_usage, """, xx AS (SELECT *, greatest(1.0, (span_end - span_start) / 4.0::DOUBLE / (1 << height)) AS aim
 FROM nodes) SELECT height, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, min(span_start) AS span_start, max(span_end) AS span_end,
 avg((token_count - aim) / aim * 100) AS deviation FROM xx GROUP BY 1""")


@query("g08_backward", REC + """, c AS (SELECT session, max(line) - session % 60 AS cutoff FROM r GROUP BY 1), x AS (SELECT r.session, uuid, line,
 row_number() OVER (PARTITION BY r.session ORDER BY line DESC) AS back, count(*) OVER (PARTITION BY r.session) AS n FROM r
 JOIN c USING (session) WHERE line > cutoff) SELECT session, uuid, n <= 40 AS complete FROM x WHERE back <= 40""")
def backward(spark, d):
    r = S.transcript(_events(spark, d)).select("session", "uuid", "line", F.col("line").alias("ts"))
    cut = r.groupBy("session").agg((F.max("line") - F.first("session") % 60).alias("cutoff"))
    return M.backward(r, cut, 40).select("session", "uuid", "complete")


@query("m20_token_f1_all_turns", """WITH c AS (SELECT a.conv_id * 1000 + a.turn AS pair, a.text AS x, b.text AS y FROM conversations a
 JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 w AS (SELECT pair, side, unnest(regexp_split_to_array(regexp_replace(lower(t), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+')) AS w
 FROM (SELECT pair, 'x' AS side, x AS t FROM c UNION ALL SELECT pair, 'y', y
 FROM c)), k AS (SELECT pair, w, count(*) FILTER (side = 'x') AS a, count(*) FILTER (side = 'y') AS b FROM w WHERE w <> '' GROUP BY 1, 2)
 SELECT pair, CASE WHEN sum(least(a, b)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(least(a, b)) / (sum(a) + sum(b)) END AS f1 FROM k GROUP BY 1""")
def f1_all(spark, d):
    c = S.read(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return T.token_f1(c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), F.col("text").alias("x"), "y"), "x", "y", "pair")
