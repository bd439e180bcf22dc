"""The driver tables as the model's relations: leaves, nodes, units, journal and transcript records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K

CHUNK = 400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sizes(docs: DataFrame) -> DataFrame:
    """document_id, n_chars (code points) and n_leaves; a document without text has one empty leaf."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return docs.select(F.col("doc_id").alias("document_id"), n.alias("len")).withColumn("n_leaves", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("len") / CHUNK)))


def token_count(chars: Column) -> Column:
    """A token for every four characters, one at least, none for no text."""
    return F.when(chars == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(chars / 4)))


def nodes(docs: DataFrame) -> DataFrame:
    """Every node of every document's complete forest, from the lengths alone: no join and no shuffle."""
    s = sizes(docs).withColumn("height", F.explode(F.sequence(F.lit(0), K.max_height(F.col("n_leaves")))))
    s = s.withColumn("width", F.floor(F.col("n_leaves") / F.pow(F.lit(2.0), F.col("height")))).withColumn("level_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)))
    h, li, d = F.col("height"), F.col("level_index"), F.col("document_id")
    s = s.withColumn("span_start", F.least(F.col("len"), K.first_leaf(h, li) * CHUNK)).withColumn("span_end", F.least(F.col("len"), (K.last_leaf(h, li) + 1) * CHUNK))
    # a parent keeps the share 2 ** -height of its span's tokens
    tok = F.floor(token_count(F.col("span_end") - F.col("span_start")) / F.pow(F.lit(2.0), h)).cast("bigint")
    up = F.floor(F.col("n_leaves") / F.pow(F.lit(2.0), h + 1))
    return s.select(
        K.node_id(d, h, li).alias("id"), "document_id", h.cast("int").alias("height"), "level_index", "span_start", "span_end", tok.alias("token_count"),
        F.when(F.shiftright(li, 1) < up, K.node_id(d, h + 1, F.shiftright(li, 1))).alias("parent_id"),
        F.when(h > 0, K.node_id(d, h - 1, li * 2)).alias("left_child_id"), F.when(h > 0, K.node_id(d, h - 1, li * 2 + 1)).alias("right_child_id"),
        F.when(li > 0, K.node_id(d, h, li - 1)).alias("preceding_neighbor_id"), F.when(li + 1 < F.col("width"), K.node_id(d, h, li + 1)).alias("following_neighbor_id"),
    )


def with_text(nodes_: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with the text of the extractive summariser: the first 4 * token_count characters of the span."""
    t = docs.select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("__text"))
    take = F.when(F.col("height") == 0, F.col("span_end") - F.col("span_start")).otherwise(F.col("token_count") * 4)
    return nodes_.join(t, "document_id").withColumn("text", F.substring("__text", F.col("span_start").cast("int") + 1, take.cast("int"))).drop("__text")


def leaf_texts(docs: DataFrame) -> DataFrame:
    """id and text of every leaf, cut from its document's text where it stands: no join and no shuffle."""
    t = docs.select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("__text"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / CHUNK)).alias("__n"))
    x = t.withColumn("level_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    return x.select("document_id", "level_index", K.node_id(F.col("document_id"), F.lit(0), F.col("level_index")).alias("id"), F.substring("__text", (F.col("level_index") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("text"))


def units(conversations: DataFrame) -> DataFrame:
    """One leaf a turn: running spans and times of turn * 60 seconds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    end = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return conversations.select(
        F.col("conv_id").alias("document_id"), (F.row_number().over(w) - 1).cast("bigint").alias("level_index"), (end - n).alias("span_start"), end.alias("span_end"),
        token_count(n).alias("token_count"), (F.col("turn") * 60.0).alias("time_start"), (F.col("turn") * 60.0).alias("time_end"), "role",
    )


def journal(events: DataFrame) -> DataFrame:
    """Events as journal records of an append key (the user)."""
    kinds = F.when(F.col("event_id") % 4 == 0, "append_started").when(F.col("event_id") % 4 == 1, "node_committed").when(F.col("event_id") % 4 == 2, "append_completed").otherwise("append_failed")
    return events.select("event_id", F.col("user_id").alias("append_id"), "ts", kinds.alias("event"), "value")


def transcript(events: DataFrame) -> DataFrame:
    """Records of a session (the user) in file order; every seventh record has no parent, every fifth skips one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.select(F.col("event_id").alias("uuid"), F.col("user_id").alias("session"), "ts", F.row_number().over(w).alias("line"), F.lag("event_id").over(w).alias("prev"), F.lag("event_id", 2).over(w).alias("prev2"), (F.col("event_id") % 3 == 0).alias("is_user"))
    parent = F.when(F.col("uuid") % 7 == 0, None).when(F.col("uuid") % 5 == 0, F.coalesce("prev2", "prev")).otherwise(F.col("prev"))
    return e.withColumn("parent", parent).drop("prev", "prev2")


def attempts(events: DataFrame) -> DataFrame:
    """Three events are the summary attempts of a node; the accepted index of a quarter of the nodes is out of range."""
    e = F.col("event_id")
    node = F.floor(e / 3)
    target = (node % 7 + 2) * 25
    actual = target + e * 13 % 61 - 30
    return events.select(
        node.alias("node_id"), (e % 3).alias("attempt"), (node % 4).alias("accepted"), (node % 5 + node % 2).alias("height"), target.alias("target_tokens"), actual.alias("actual_tokens"),
        (actual + e % 4).alias("prompt_tokens"), F.when(e % 11 == 0, 0.0).otherwise(e.cast("double")).alias("start_time"), (e + 1 + e % 9).cast("double").alias("end_time"),
    )
