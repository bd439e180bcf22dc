"""Queries of the keyed state machines, as streams of several batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.plans.base import query, scratch
from arbor.sources import corpus as S
from arbor.streaming import stateful as X
from arbor.streaming.snapshots import catalog_changes

#: Batches that events come in, by their time.
BATCHES = 3


def _events(spark, d):
    return S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _changes(spark, events, make, name: str, order: str = "ts"):
    """The changes that `make` gives of the events as a stream of BATCHES batches, cut at shares of their order."""
    path, at = scratch(spark, name), F.unix_micros(order) if order == "ts" else F.col(order)
    cuts = events.select(at.cast("double").alias("x")).approxQuantile("x", [(i + 1) / BATCHES for i in range(BATCHES - 1)], 0.01)
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (at > c).cast("int")
    return X.run_parts(spark, [events.where(batch == i) for i in range(BATCHES)], make, path)


def _requests(events):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "create").when(e % 4 == 1, "get").otherwise("update")
    return events.select(F.col("user_id").alias("session_id"), e.alias("seq"), kind.alias("kind"), F.col("ts").alias("at"), (e % 100).alias("document_id"))


@query(
    "st08_session_registry",
    """WITH r AS (SELECT user_id AS session_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'get' ELSE 'update' END AS kind,
  epoch_us(ts) AS at_us, event_id % 100 AS doc, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER w AS life, lead(epoch_us(ts)) OVER w AS later
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY session_id, life ORDER BY at_us, seq) > {ttl} THEN 1 ELSE 0 END AS gap FROM r),
 f AS (SELECT *, life > 0 AND sum(gap) OVER w = 0 AS found FROM g WINDOW w AS (PARTITION BY session_id, life ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT *, first_value(doc) OVER w AS document_id, sum(CASE WHEN kind = 'update' AND found THEN 1 ELSE 0 END) OVER w AS updates FROM f
  WINDOW w AS (PARTITION BY session_id, life ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING))
 SELECT session_id, seq, kind, at_us, found, CASE WHEN found THEN document_id END AS document_id, CASE WHEN found THEN CAST(1 + updates AS BIGINT) END AS turn FROM a
 UNION ALL SELECT session_id, NULL, 'expired', max(at_us) + {ttl}, true, NULL, NULL FROM a WHERE found GROUP BY session_id, life
 HAVING CASE arg_max(coalesce(later, -1), (at_us, seq)) WHEN -1 THEN max(at_us) + {ttl} < (SELECT max(epoch_us(ts)) - 60000000 FROM events)
  ELSE arg_max(coalesce(later, -1), (at_us, seq)) > max(at_us) + {ttl} END""".replace("{ttl}", "1800000000"),
)
def session_registry(spark, d):
    """Sessions of users that end 30 minutes after their last access."""
    make = lambda stream: X.session_registry(stream.withColumnRenamed("ts", "at"))
    return _changes(spark, _requests(_events(spark, d)).withColumnRenamed("at", "ts"), make, "registry").drop("batch")


_HISTORY = """WITH j AS (SELECT event_id, user_id AS append_id, ts, CASE event_id % 4 WHEN 0 THEN 'in_progress' WHEN 2 THEN
 'completed' ELSE 'failed' END AS status FROM events WHERE event_id % 4 <> 1)
 SELECT append_id, arg_min(event_id, (ts, event_id)) AS first_seen, arg_max(status, (ts, event_id)) AS status, epoch_us(max(ts) FILTER (status =
 'in_progress')) AS started_us, epoch_us(max(ts) FILTER (status <> 'in_progress')) AS ended_us FROM j GROUP BY 1
 HAVING arg_max(status, (ts, event_id)) <> 'in_progress'"""


@query("st04_history_stream", _HISTORY)
def history(spark, d):
    """The history of finished runs, kept from batch to batch; the batches are cut by the events' ids, so records come out of their order in time."""
    changes = _changes(spark, _events(spark, d), lambda stream: X.run_history(S.journal(stream)), "history", "event_id")
    return X.latest(changes, "append_id").where("finished").drop("finished")


@query(
    "st04_node_stream",
    """SELECT event_id % 997 AS node_id, epoch_us(min(ts)) AS created_us, arg_max(event_id % 5, (ts, event_id)) AS height,
 arg_max(event_id, (ts, event_id)) AS span_start, arg_max(event_id + 10, (ts, event_id)) AS span_end, count(*) AS n_commits FROM events
 WHERE event_id % 4 = 1 GROUP BY 1""",
)
def nodes(spark, d):
    e = F.col("event_id")
    commits = lambda stream: stream.where(e % 4 == 1).select((e % 997).alias("node_id"), "event_id", "ts", (e % 5).alias("height"), e.alias("span_start"), (e + 10).alias("span_end"))
    return X.latest(_changes(spark, _events(spark, d), lambda stream: X.node_fold(commits(stream)), "nodes", "event_id"), "node_id")


@query(
    "st03_progress_changes",
    """SELECT key, seq, total, total = 0 AS complete FROM (SELECT user_id AS key, event_id AS seq, CAST(floor(value / 40) % 3 AS BIGINT) AS total,
 lag(CAST(floor(value / 40) % 3 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value IS NOT NULL) WHERE total IS DISTINCT FROM before""",
)
def progress(spark, d):
    """Polls of what is left, of which only changes are told."""
    polls = lambda stream: stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.floor(F.col("value") / 40) % 3).cast("long").alias("total"))
    return _changes(spark, _events(spark, d), lambda stream: X.progress_changes(polls(stream)), "progress", "event_id").drop("batch")


@query(
    "st07_latest_lists",
    """SELECT key, seq, array_to_string(ids, ',') AS ids FROM (SELECT *, lag(ids) OVER (PARTITION BY key ORDER BY seq) AS before FROM
 (SELECT user_id AS key, event_id AS seq, list_transform(list_slice(list_reverse_sort(list({'c': epoch_us(ts), 'i': event_id}) OVER (PARTITION BY user_id
 ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 1, 4), x -> x.i) AS ids FROM events)) WHERE ids IS DISTINCT FROM before""".replace("x -> x.i", "lambda x: x.i"),
)
def latest_lists(spark, d):
    """The four latest queries of every user, told when they change; records arrive by id and are dated by their time."""
    records = lambda stream: stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros("ts").alias("created"), F.col("event_id").alias("id"))
    return _changes(spark, _events(spark, d), lambda stream: X.latest_changes(records(stream), 4), "lists", "event_id").select("key", "seq", F.array_join("ids", ",").alias("ids"))


@query(
    "st06_catalog_changes",
    """WITH u AS (SELECT DISTINCT user_id AS id FROM events), s AS (SELECT id, k AS snapshot, CAST((id * 7 + k) // 3 % 5 AS VARCHAR) AS value
  FROM u, range(0, 6) r(k) WHERE (id + k) % 4 <> 0 AND k <> 4),
 x AS (SELECT *, lag(snapshot) OVER w AS p, lag(value) OVER w AS v, lead(snapshot) OVER w AS n FROM s WINDOW w AS (PARTITION BY id ORDER BY snapshot))
 SELECT snapshot, id, CASE WHEN p IS NULL OR p <> snapshot - 1 THEN 'inserted' ELSE 'changed' END AS kind, value FROM x WHERE p IS NULL OR p <> snapshot - 1 OR v <> value
 UNION ALL SELECT snapshot + 1, id, 'removed', NULL FROM x WHERE snapshot < 5 AND (n IS NULL OR n <> snapshot + 1)""",
)
def catalog(spark, d):
    """Six snapshots of the users in two batches; the fifth is empty."""
    path, users = scratch(spark, "catalog"), S.read(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    rows = users.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("snapshot"), "id", F.lit("").alias("value")).withColumn("value", (F.floor((F.col("id") * 7 + F.col("snapshot")) / 3) % 5).cast("string"))
    rows = rows.where("(id + snapshot) % 4 <> 0 and snapshot <> 4")
    heads = spark.range(0, 6).select(F.col("id").alias("snapshot"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("value"))
    both = rows.unionByName(heads)
    return catalog_changes(X.stream_of(spark, [both.where("snapshot < 2"), both.where("snapshot >= 2")], f"{path}/in"), path)
