"""Scans, filters, aggregates and windows over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K


def multi_get(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def page(nodes: DataFrame, size: int) -> DataFrame:
    """Pages of each document in id order."""
    return nodes.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1) / size))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("height = 0")


def by_coordinates(nodes: DataFrame, coords: DataFrame) -> DataFrame:
    return nodes.join(coords.select("document_id", "height", "level_index").distinct(), ["document_id", "height", "level_index"], "left_semi")


def overlapping(nodes: DataFrame, start: int, end: int, min_height: int, limit: int) -> DataFrame:
    """The highest nodes that overlap a span, the first `limit` of each document, with the number of all."""
    hit = nodes.where((F.col("span_start") < end) & (F.col("span_end") > start) & (F.col("height") >= min_height))
    w = Window.partitionBy("document_id").orderBy(F.desc("height"), "span_start", "level_index", "id")
    every = Window.partitionBy("document_id")
    return hit.withColumn("total", F.count("*").over(every)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def leaf_at(nodes: DataFrame, points: DataFrame, width: int = 4096) -> DataFrame:
    """The leaf whose half-open span holds each (document_id, position).

    Leaves are dealt to the stretches of `width` characters that they touch, so points meet the few leaves of their stretch
    and not all of a long document.
    """
    at = lambda c: F.floor(c / width)
    dealt = leaves(nodes).where("span_end > span_start").select("document_id", "id", "span_start", "span_end", F.explode(F.sequence(at(F.col("span_start")), at(F.col("span_end") - 1))).alias("__stretch"))
    met = points.withColumn("__stretch", at(F.col("position"))).join(dealt, ["document_id", "__stretch"])
    return met.where("span_start <= position and position < span_end").select("document_id", "position", "id")


def ready_left_children(nodes: DataFrame) -> DataFrame:
    """Roots with an even index that do not span their document and have their neighbours unless at an edge."""
    span = nodes.withColumn("doc_end", F.max("span_end").over(Window.partitionBy("document_id")))
    ok = F.col("parent_id").isNull() & (F.col("level_index") % 2 == 0) & ~((F.col("span_start") == 0) & (F.col("span_end") == F.col("doc_end")))
    edge = (F.col("preceding_neighbor_id").isNotNull() | (F.col("span_start") == 0)) & (F.col("following_neighbor_id").isNotNull() | (F.col("span_end") == F.col("doc_end")))
    return span.where(ok & edge).drop("doc_end")


def document_status(nodes: DataFrame) -> DataFrame:
    """Counts, sizes and completeness of every document in one aggregate."""
    leaf = F.col("height") == 0
    root = F.col("parent_id").isNull()
    a = nodes.groupBy("document_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.count_if(root).alias("n_roots"), F.max("height").cast("bigint").alias("height"), F.max("span_end").alias("length"),
        F.coalesce(F.sum(F.when(leaf, F.col("token_count"))), F.lit(0)).alias("leaf_tokens"), F.coalesce(F.sum(F.when(root, F.col("token_count"))), F.lit(0)).alias("root_tokens"),
        F.sum(F.when(leaf, F.col("span_end") - F.col("span_start"))).alias("leaf_chars"),
    )
    n = F.col("n_leaves")
    best = F.bit_count(n) + K.max_height(n)
    return a.select(
        "*", F.floor(F.col("leaf_tokens") / n).cast("bigint").alias("avg_leaf_tokens"), F.when(F.col("leaf_tokens") > 0, F.col("leaf_chars") / F.col("leaf_tokens")).alias("chars_per_token"),
        K.forest_size(n).cast("bigint").alias("expected_nodes"), F.when(n <= 1, F.lit(1.0)).otherwise(best / (F.col("n_roots") + F.col("height"))).alias("completeness"),
    )


def token_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("height").agg(F.count("*").alias("n"), F.sum("token_count").alias("total"), F.avg("token_count").alias("mean"), F.min("token_count").alias("least"), F.max("token_count").alias("most"))


def root_histogram(nodes: DataFrame) -> DataFrame:
    """Roots by height and the pairs that could merge."""
    return roots(nodes).groupBy("height").agg(F.count("*").alias("n_roots")).withColumn("pairs", F.floor(F.col("n_roots") / 2))


def recent_leaves(nodes: DataFrame, budget: int, upto: int | None = None) -> DataFrame:
    """The last leaves of every document within a token budget, with the one that crosses it."""
    x = leaves(nodes) if upto is None else leaves(nodes).where(F.col("span_end") <= upto)
    w = Window.partitionBy("document_id").orderBy(F.desc("span_end"), F.desc("level_index")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("running", F.sum("token_count").over(w)).where(F.col("running") - F.col("token_count") < budget)


def completion_frontier(nodes: DataFrame, least: float) -> DataFrame:
    """First root, left to right, where the completeness of what is left of it and itself falls below a bound."""
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.pow(F.lit(2.0), F.col("height")).cast("bigint")).over(w)
    r = roots(nodes).withColumn("n", n).withColumn("k", F.count("*").over(w)).withColumn("h", F.max("height").over(w))
    c = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((F.bit_count("n") + K.max_height(F.col("n"))) / (F.col("k") + F.col("h")))
    return r.withColumn("c", c).groupBy("document_id").agg(F.min(F.when(F.col("c") < least, F.col("span_start"))).alias("frontier"), F.min("c").alias("least_completeness"))


def fork_budget_suffix(nodes: DataFrame, cap: int) -> DataFrame:
    """The smallest run of roots at the right end that reaches a token cap; none for a cap of 0."""
    w = Window.partitionBy("document_id").orderBy(F.desc("span_start"), F.desc("level_index")).rowsBetween(Window.unboundedPreceding, 0)
    return roots(nodes).withColumn("cum", F.sum("token_count").over(w)).where((F.col("cum") - F.col("token_count") < cap) & F.lit(cap > 0))


def upsert(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes replace rows with their id, but height stays as it was."""
    old = nodes.select("id", F.col("height").alias("__h"))
    new = changes.join(old, "id", "left").withColumn("height", F.coalesce("__h", "height")).drop("__h").select(*nodes.columns)
    return nodes.join(changes.select("id"), "id", "left_anti").unionByName(new)


def truncate_from(nodes: DataFrame, position: int) -> DataFrame:
    """Deletes what ends after a position and clears the links of the rest to it."""
    kept = nodes.where(F.col("span_end") <= position)
    ids = kept.select(F.col("id").alias("__id"))
    for c in ("parent_id", "following_neighbor_id"):
        kept = kept.join(ids.withColumnRenamed("__id", f"__{c}"), F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    return kept


def ancestors(below: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, id) of all ancestors that exist: an explode over heights and one join on coordinates."""
    tops = nodes.groupBy("document_id").agg(F.max("height").alias("top"))
    up = below.join(tops, "document_id").where(F.col("height") < F.col("top")).select("document_id", F.col("id").alias("source"), "height", "level_index", F.explode(F.sequence(F.col("height") + 1, F.col("top"))).alias("h"))
    at = up.select("document_id", "source", F.col("h").alias("height"), K.ancestor_index(F.col("height"), F.col("level_index"), F.col("h")).alias("level_index"))
    return at.join(nodes.select("document_id", "height", "level_index", "id"), ["document_id", "height", "level_index"])


def children(nodes: DataFrame) -> DataFrame:
    """Ids of both children by coordinates alone; null for leaves."""
    doc, (lh, ll), (rh, rl) = F.col("document_id"), K.left_child(F.col("height"), F.col("level_index")), K.right_child(F.col("height"), F.col("level_index"))
    return nodes.withColumn("left", F.when(lh.isNotNull(), K.node_id(doc, lh, ll))).withColumn("right", F.when(rh.isNotNull(), K.node_id(doc, rh, rl)))


def within_leaves(nodes: DataFrame, lo: int, hi: int) -> DataFrame:
    """Nodes whose leaves all lie in a range of leaf indexes."""
    return nodes.where(K.within(F.col("height"), F.col("level_index"), F.lit(lo), F.lit(hi)))


def cost_stats(nodes: DataFrame) -> DataFrame:
    """Costs, nodes, leaves and summaries of every document in one aggregate."""
    return nodes.groupBy("document_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("n_nodes"), F.count_if(F.col("height") == 0).alias("n_leaves"), F.count_if(F.col("height") > 0).alias("n_summaries"))


def validation_metrics(nodes: DataFrame) -> DataFrame:
    """Conditional counts of every document."""
    return nodes.groupBy("document_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("height") == 0).alias("n_leaves"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"),
        F.count_if((F.col("height") > 0) & F.col("left_child_id").isNull()).alias("no_children"), F.count_if(F.col("span_end") <= F.col("span_start")).alias("empty_spans"), F.count_if(F.col("token_count") == 0).alias("no_tokens"),
    )


def root_stats(nodes: DataFrame) -> DataFrame:
    return roots(nodes).groupBy("document_id").agg(F.sum("token_count").alias("tokens"), F.max("height").alias("height"), F.count("*").alias("n_roots"))
