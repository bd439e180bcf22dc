"""The registry itself: queries by name, their SQL and the SQL of nodes."""

from __future__ import annotations

import uuid

from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S

QUERIES: dict = {}
ORACLES: dict = {}

NODES = r"""
WITH s AS (SELECT doc_id AS document_id, CAST(length(coalesce(text, '')) AS BIGINT) AS len,
                  greatest(1, CAST(ceil(length(coalesce(text, '')) / 400.0) AS BIGINT)) AS n_leaves FROM documents),
h AS (SELECT *, unnest(range(0, length(bin(n_leaves)))) AS height FROM s),
w AS (SELECT *, n_leaves >> height AS width FROM h),
x AS (SELECT *, unnest(range(0, width)) AS level_index FROM w),
y AS (SELECT *, least(len, (level_index << height) * 400) AS span_start, least(len, ((level_index + 1) << height) * 400) AS span_end,
             document_id || ':' || height || ':' AS p FROM x),
nodes AS (SELECT p || level_index AS id, document_id, height, level_index, span_start, span_end,
   (CASE WHEN span_end = span_start THEN 0 ELSE greatest(1, (span_end - span_start) // 4) END) >> height AS token_count,
   CASE WHEN (level_index >> 1) < (n_leaves >> (height + 1)) THEN document_id || ':' || (height + 1) || ':' || (level_index >> 1) END AS parent_id,
   CASE WHEN height > 0 THEN document_id || ':' || (height - 1) || ':' || (level_index * 2) END AS left_child_id,
   CASE WHEN height > 0 THEN document_id || ':' || (height - 1) || ':' || (level_index * 2 + 1) END AS right_child_id,
   CASE WHEN level_index > 0 THEN p || (level_index - 1) END AS preceding_neighbor_id,
   CASE WHEN level_index + 1 < width THEN p || (level_index + 1) END AS following_neighbor_id FROM y)
"""
REC = """WITH r AS (SELECT event_id AS uuid, user_id AS session, row_number() OVER w AS line, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0
 THEN coalesce(lag(event_id, 2) OVER w, lag(event_id) OVER w) ELSE lag(event_id) OVER w END AS parent, lag(event_id) OVER w AS prev, event_id % 3 = 0
 AS is_user FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) """


def query(name: str, sql: str | None = None, nodes: bool = False):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (NODES if nodes else "") + sql
        return f

    return wrap


def nodes_of(spark, d):
    return S.nodes(S.read(spark, d, "documents"))


def simple(name: str, make, sql: str):
    """A query over nodes."""
    query(name, sql, nodes=True)(lambda spark, d: make(nodes_of(spark, d)))


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
