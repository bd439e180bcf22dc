"""Depths, windows and prefixes by coordinate arithmetic, and checks of stored contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K


def _two(h: Column) -> Column:
    return F.pow(F.lit(2.0), h).cast("bigint")


def depth(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes with their distance to their root: the highest ancestor that a complete forest of n_leaves has."""
    n = sizes.select("document_id", "n_leaves")
    there = lambda k: F.floor(F.col("level_index") / _two(k - F.col("height"))) < F.floor(F.col("n_leaves") / _two(k))
    top = F.array_max(F.filter(F.sequence(F.col("height"), K.max_height(F.col("n_leaves")).cast("int")), there))
    return nodes.join(n, "document_id").withColumn("depth", top - F.col("height")).drop("n_leaves")


def edge_max(li: Column, lo: Column, hi: Column, top: Column, left: bool) -> Column:
    """Height of the highest ancestor that a window's first (or last) leaf can climb to as a left (right) edge inside it."""

    def inside(k):
        size = _two(k)
        return (li % size == 0) & (li + size - 1 <= hi) if left else ((li + 1) % size == 0) & (li + 1 - size >= lo)

    return F.array_max(F.filter(F.sequence(F.lit(0), top.cast("int")), inside))


def window_bounds(windows: DataFrame) -> DataFrame:
    """document_id, lo, hi, top -> the nodes (height, level_index) at both edges of leaf windows."""
    lo, hi, top = F.col("lo"), F.col("hi"), F.col("top")
    x = windows.withColumn("left_height", edge_max(lo, lo, hi, top, True)).withColumn("right_height", edge_max(hi, lo, hi, top, False))
    return x.withColumn("left_index", F.floor(lo / _two(F.col("left_height")))).withColumn("right_index", F.floor(hi / _two(F.col("right_height"))))


def prefix(leaves: DataFrame) -> DataFrame:
    """Maximal nodes that cover all leaves before a leaf, in order: one for each set bit of its index."""
    li = F.col("level_index")
    bits = F.filter(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), lambda k: F.floor(li / _two(k)) % 2 == 1)
    return leaves.select("document_id", F.col("id").alias("leaf_id"), li.alias("leaf_index"), F.posexplode(bits).alias("position", "height")).withColumn("level_index", F.floor(F.col("leaf_index") / _two(F.col("height"))) - 1)


def contexts(leaves: DataFrame) -> DataFrame:
    """Leaves with their preceding context, a JSON array of node ids."""
    li = F.col("level_index")
    bits = F.filter(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), lambda k: F.floor(li / _two(k)) % 2 == 1)
    ids = F.transform(bits, lambda k: K.node_id(F.col("document_id"), k, F.floor(li / _two(k)) - 1))
    return leaves.withColumn("context", F.to_json(ids))


def check_contexts(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(document_id, code, node_id): contexts that are no JSON array, name missing nodes, have gaps or end before their leaf."""
    x = leaves.withColumn("ids", F.from_json("context", "array<string>"))
    bad = x.where("context is null or ids is null").select("document_id", F.lit("context.parse").alias("code"), F.col("id").alias("node_id"))
    e = x.select("document_id", F.col("id").alias("node_id"), F.col("span_start").alias("leaf_start"), F.posexplode("ids").alias("at", "id"))
    e = e.join(nodes.select("id", "span_start", "span_end"), "id", "left")
    w = Window.partitionBy("node_id").orderBy("at")
    e = e.withColumn("before", F.lag("span_end").over(w)).withColumn("after", F.lead("at").over(w))
    code = F.when(F.col("span_start").isNull(), "context.missing").when(F.coalesce("before", F.when(F.col("at") == 0, 0)) != F.col("span_start"), "context.gap").when(F.col("after").isNull() & (F.col("span_end") != F.col("leaf_start")), "context.end")
    empty = x.where("size(ids) = 0 and span_start > 0").select("document_id", F.lit("context.end").alias("code"), F.col("id").alias("node_id"))
    return bad.unionByName(empty).unionByName(e.select("document_id", code.alias("code"), "node_id").where("code is not null").distinct())


def leaf_depth(nodes: DataFrame) -> DataFrame:
    """Inner nodes whose children are not both one lower."""
    kid = lambda s: nodes.select(F.col("id").alias(f"{s}_child_id"), F.col("height").alias(f"__{s}"))
    x = nodes.where("height > 0").join(kid("left"), "left_child_id", "left").join(kid("right"), "right_child_id", "left")
    return x.where("not (__left <=> height - 1) or not (__right <=> height - 1)").select("document_id", F.lit("leaf.depth").alias("code"), F.col("id").alias("node_id"))


def coverage_roots(cover: DataFrame) -> DataFrame:
    """Covered nodes without a covered parent."""
    have = cover.select("query_id", F.col("id").alias("parent_id"))
    return cover.join(have, ["query_id", "parent_id"], "left_anti")


def seed_count(budget: Column, avg_leaf_tokens: Column, default: int = 100) -> Column:
    """Seeds that a budget pays for, one at least."""
    per = F.when(avg_leaf_tokens > 0, avg_leaf_tokens).otherwise(default)
    return F.greatest(F.lit(1), F.floor(budget / per)).cast("bigint")


def hybrid(vector: DataFrame, fused: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Fused order of candidates; ids of the text search alone stay only where they have a vector, queries without vector candidates drop out."""
    asked = vector.select("query_id").distinct()
    kept = fused.join(vectors.select(key), key, "left_semi").join(asked, "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)
    return kept.withColumn("rank", F.row_number().over(w))


def hybrid_in_fused_order(vector: DataFrame, fused: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """As hybrid, in the order that the fusion gave (its rank): equal scores keep the order of the first list, then of the second."""
    kept = fused.join(vectors.select(key), key, "left_semi").join(vector.select("query_id").distinct(), "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w))


def pinned_nodes(nodes: DataFrame, sizes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Nodes with the flag `pinned`, at most so deep below their root."""
    x = depth(nodes.where("pinned"), sizes)
    return x if most_depth is None else x.where(F.col("depth") <= most_depth)
