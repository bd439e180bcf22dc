"""Queries of stored node tables and of growing journals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbor.operators import stored_nodes as W
from arbor.plans.base import NODES, nodes_of, query, scratch
from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S
from arbor.sources.tail import JournalTail
from arbor.streaming.stateful import run_changes

_COLS = ["id", "height", "token_count", "parent_id", "following_neighbor_id", "span_end"]


def _table(spark, d):
    ensure_checkpoint_dir(spark)
    path, nodes = scratch(spark, "nodes"), nodes_of(spark, d)
    W.create(nodes, path, 16)
    return nodes, path


@query("d02_stored_upsert", NODES + """SELECT id, height, token_count + CASE WHEN level_index = 1 AND document_id % 3 = 0 THEN 1000 ELSE 0 END AS token_count, parent_id,
 following_neighbor_id, span_end FROM nodes UNION ALL SELECT DISTINCT document_id || ':new', 0, 7, NULL, NULL, 5 FROM nodes WHERE document_id % 3 = 0 AND height = 0 AND level_index = 0""")
def upsert(spark, d):
    """A third of the documents: changed nodes, whose height stays, and new ones; read from what was written."""
    nodes, path = _table(spark, d)
    some = nodes.where("document_id % 3 = 0")
    changed = some.where("level_index = 1").withColumn("token_count", F.col("token_count") + 1000).withColumn("height", F.lit(99))
    none = [F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c not in ("id", "document_id", "height", "token_count", "span_end")]
    new = some.where("height = 0 and level_index = 0").select(F.concat("document_id", F.lit(":new")).alias("id"), "document_id", F.lit(0).alias("height"), F.lit(7).cast("long").alias("token_count"), F.lit(5).cast("long").alias("span_end"), *none)
    W.upsert(changed.unionByName(new), path)
    return W.read(spark, path).select(*_COLS)


@query("d03_stored_update", NODES + "SELECT id, height, CASE WHEN height = 1 AND document_id % 2 = 0 THEN level_index ELSE token_count END AS token_count, CASE WHEN height = 1 AND document_id % 2 = 0 THEN NULL ELSE parent_id END AS parent_id, following_neighbor_id, span_end FROM nodes")
def bulk_update(spark, d):
    nodes, path = _table(spark, d)
    W.bulk_update(nodes.where("height = 1 and document_id % 2 = 0").select("id", "document_id", F.col("level_index").alias("token_count"), F.lit(None).cast("string").alias("parent_id")), path)
    return W.read(spark, path).select(*_COLS)


@query("d06_stored_delete", NODES + "SELECT id, height, token_count, parent_id, following_neighbor_id, span_end FROM nodes WHERE NOT (document_id % 4 = 1 AND (level_index = 0 OR document_id % 8 = 1))")
def delete(spark, d):
    """Some nodes of some documents, and all of others."""
    nodes, path = _table(spark, d)
    W.delete(nodes.where("document_id % 4 = 1 and (level_index = 0 or document_id % 8 = 1)").select("id", "document_id"), path)
    return W.read(spark, path).select(*_COLS)


@query("d07_stored_truncate", NODES + """, k AS (SELECT * FROM nodes WHERE document_id % 2 = 0 OR span_end <= 400 * (document_id % 9)) SELECT k.id, k.height, k.token_count, p.id AS parent_id, f.id AS
 following_neighbor_id, k.span_end FROM k LEFT JOIN k p ON k.parent_id = p.id LEFT JOIN k f ON k.following_neighbor_id = f.id""")
def truncate(spark, d):
    """Every second document at a position of its own."""
    nodes, path = _table(spark, d)
    W.truncate(nodes.where("document_id % 2 = 1").select("document_id", (F.col("document_id") % 9 * 400).alias("position")).distinct(), path)
    return W.read(spark, path).select(*_COLS)


def _journal(spark, d, path, keep):
    e = F.col("event_id")
    j = S.journal(S.read(spark, d, "events")).where(keep)
    line = F.when(e % 10 == 9, F.lit('{"event": "append_')).otherwise(F.to_json(F.struct("event", "event_id", "append_id")))
    j.select(line.alias("value")).write.mode("append").text(path)


@query("st05_journal_tail", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'append_started' ELSE 'append_completed' END AS event FROM events WHERE event_id % 4 IN (0, 2) AND event_id % 10 <> 9")
def tail(spark, d):
    """A journal that has grown between two runs of its tail; the second reads what is new. Broken lines and other events are left out."""
    path = scratch(spark, "tail")
    spark.dataSource.register(JournalTail)
    stream = spark.readStream.format("journal_tail").option("path", f"{path}/log").option("types", "append_started,append_completed").load()
    _journal(spark, d, f"{path}/log", F.col("event_id") % 3 < 2)
    run_changes(stream, path)
    _journal(spark, d, f"{path}/log", F.col("event_id") % 3 == 2)
    got = run_changes(stream, path)
    return got.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "event")


@query("s15_seek_offset", "SELECT event_id FROM events WHERE event_id % 10 <> 9")
def seek(spark, d):
    """Two reads of the files, before byte 700 and from there on; the second seeks."""
    path = f"{scratch(spark, 'tail')}/log"
    spark.dataSource.register(JournalTail)
    _journal(spark, d, path, F.lit(True))
    read = lambda at: spark.read.format("journal_tail").option("path", path).option("offset", at).load()
    both = read(0).where("offset < 700").unionByName(read(700))
    return both.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"))
