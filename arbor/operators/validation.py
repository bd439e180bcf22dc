"""Integrity checks: each returns (document_id, code, node_id); a valid forest returns none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _found(df: DataFrame, code: str, node: str = "id") -> DataFrame:
    return df.select("document_id", F.lit(code).alias("code"), F.col(node).alias("node_id"))


def leaf_spans(nodes: DataFrame) -> DataFrame:
    """Leaves start at 0 and follow each other."""
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index")
    x = nodes.where("height = 0").withColumn("before", F.lag("span_end").over(w))
    return _found(x.where("before is null and span_start <> 0"), "leaf.span_start").unionByName(_found(x.where("before is not null and before <> span_start"), "leaf.gap"))


def parent_links(nodes: DataFrame) -> DataFrame:
    """A parent exists and claims the child; null-safe, so a parent without children disclaims."""
    p = nodes.select(F.col("id").alias("pid"), F.col("left_child_id").alias("pl"), F.col("right_child_id").alias("pr"))
    x = nodes.where("parent_id is not null").join(p, F.col("parent_id") == F.col("pid"), "left")
    lost = _found(x.where("pid is null"), "parent.missing")
    return lost.unionByName(_found(x.where("pid is not null and not (pl <=> id) and not (pr <=> id)"), "parent.disclaims"))


def child_links(nodes: DataFrame) -> DataFrame:
    """Both children exist or neither is named."""
    out = [_found(nodes.where("(left_child_id is null) <> (right_child_id is null)"), "tree.one_child")]
    for c in ("left", "right"):
        out.append(_found(nodes.where(f"{c}_child_id is not null").join(nodes.select(F.col("id").alias(f"{c}_child_id")), f"{c}_child_id", "left_anti"), f"child.{c}_missing"))
    return reduce(DataFrame.unionByName, out)


def child_spans(nodes: DataFrame) -> DataFrame:
    """A parent spans its children and is one higher."""
    child = lambda s: nodes.select(F.col("id").alias(f"{s}_child_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("span_start", "span_end", "height", "level_index")])
    x = nodes.join(child("left"), "left_child_id").join(child("right"), "right_child_id")
    checks = {"span.start": "span_start <> left_span_start", "span.end": "span_end <> right_span_end", "span.children": "left_span_end <> right_span_start", "coord.height": "height <> left_height + 1 or height <> right_height + 1", "coord.index": "left_level_index <> level_index * 2 or right_level_index <> level_index * 2 + 1"}
    return reduce(DataFrame.unionByName, [_found(x.where(q), c) for c, q in checks.items()])


def neighbors(nodes: DataFrame) -> DataFrame:
    """Neighbours are the nodes before and after at the same height."""
    w = Window.partitionBy("document_id", "height").orderBy("level_index")
    x = nodes.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    return _found(x.where("not (preceding_neighbor_id <=> before)"), "neighbor.preceding").unionByName(_found(x.where("not (following_neighbor_id <=> after)"), "neighbor.following"))


def coordinates(nodes: DataFrame) -> DataFrame:
    """No coordinate is used twice, and neighbours that could merge have a parent."""
    w = Window.partitionBy("document_id", "height", "level_index")
    twice = _found(nodes.withColumn("n", F.count("*").over(w)).where("n > 1"), "coord.duplicate")
    r = nodes.where("parent_id is null").select("document_id", "height", (F.col("level_index") - 1).alias("level_index"))
    return twice.unionByName(_found(nodes.where("parent_id is null and level_index % 2 = 0").join(r, ["document_id", "height", "level_index"], "left_semi"), "forest.unmerged"))


def chunk_size(nodes: DataFrame, most: int) -> DataFrame:
    return _found(nodes.where((F.col("height") == 0) & (F.col("token_count") > most)), "leaf.too_large")


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Only whether a named parent exists."""
    return _found(nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti"), "parent.missing")


def missing_children(nodes: DataFrame) -> DataFrame:
    """Only whether named children exist, one row a missing child."""
    out = [_found(nodes.where(f"{c}_child_id is not null").join(nodes.select(F.col("id").alias(f"{c}_child_id")), f"{c}_child_id", "left_anti"), f"child.{c}_missing") for c in ("left", "right")]
    return out[0].unionByName(out[1])


def height_rule(nodes: DataFrame) -> DataFrame:
    """One row a child that is not one lower than the node that names it."""
    kids = nodes.select("document_id", F.col("id").alias("node_id"), F.col("height").alias("h"), F.explode(F.array("left_child_id", "right_child_id")).alias("id"))
    x = kids.where("id is not null").join(nodes.select("id", "height"), "id")
    return x.where("h <> height + 1").select("document_id", F.lit("coord.height_mismatch").alias("code"), "node_id")


def neighbor_chain(nodes: DataFrame) -> DataFrame:
    """A following neighbour exists at the same height, one further."""
    to = nodes.select(F.col("id").alias("following_neighbor_id"), F.col("height").alias("fh"), F.col("level_index").alias("fl"))
    x = nodes.where("following_neighbor_id is not null").join(to, "following_neighbor_id", "left")
    return _found(x.where("fh is null or fh <> height or fl <> level_index + 1"), "neighbor.chain")


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first findings in a fixed order."""
    return findings.orderBy("document_id", "code", "node_id").limit(n)


CHECKS = (leaf_spans, parent_links, child_links, child_spans, neighbors, coordinates)


def _coded(**rules: str) -> Column:
    """Codes whose rule holds; dots of codes are written as two underscores."""
    return F.array_compact(F.array(*[F.when(F.expr(q), F.lit(c.replace("__", "."))) for c, q in rules.items()]))


def validate(nodes: DataFrame) -> DataFrame:
    """All findings of CHECKS in one pass: three joins on ids and two windows, where the checks one by one take five joins and four windows.

    Ids must be unique; nodes whose coordinates are taken twice are found by their order.
    """
    fields = ("span_start", "span_end", "height", "level_index", "left_child_id", "right_child_id")
    to = lambda key, p, cols: nodes.select(F.col("id").alias(key), F.lit(True).alias(f"{p}_there"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    w = Window.partitionBy("document_id", "height").orderBy("level_index")
    x = nodes.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    for p, f in (("b", F.lag), ("a", F.lead)):
        x = x.withColumn(f"{p}_index", f("level_index").over(w)).withColumn(f"{p}_parent", f("parent_id").over(w))
    x = x.join(to("parent_id", "p", fields[4:]), "parent_id", "left").join(to("left_child_id", "l", fields[:4]), "left_child_id", "left").join(to("right_child_id", "r", fields[:4]), "right_child_id", "left")
    both = "l_there and r_there and "
    codes = _coded(
        parent__missing="parent_id is not null and p_there is null",
        parent__disclaims="p_there and not (p_left_child_id <=> id) and not (p_right_child_id <=> id)",
        tree__one_child="(left_child_id is null) <> (right_child_id is null)",
        child__left_missing="left_child_id is not null and l_there is null",
        child__right_missing="right_child_id is not null and r_there is null",
        span__start=both + "span_start <> l_span_start",
        span__end=both + "span_end <> r_span_end",
        span__children=both + "l_span_end <> r_span_start",
        coord__height=both + "(height <> l_height + 1 or height <> r_height + 1)",
        coord__index=both + "(l_level_index <> level_index * 2 or r_level_index <> level_index * 2 + 1)",
        neighbor__preceding="not (preceding_neighbor_id <=> before)",
        neighbor__following="not (following_neighbor_id <=> after)",
        coord__duplicate="b_index <=> level_index or a_index <=> level_index",
        forest__unmerged="parent_id is null and level_index % 2 = 0 and after is not null and a_index = level_index + 1 and a_parent is null",
    )
    return leaf_spans(nodes).unionByName(x.select("document_id", F.explode(codes).alias("code"), F.col("id").alias("node_id")))


def empty_trees(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents without a node."""
    none = documents.join(nodes.select("document_id").distinct(), "document_id", "left_anti")
    return none.select("document_id", F.lit("tree.empty").alias("code"), F.lit(None).cast("string").alias("node_id"))


def node_coordinates(nodes: DataFrame) -> DataFrame:
    """The rules of coordinates one by one: leaves at height 0, parents one higher and at half the index, left even, right odd and next."""
    child = lambda s: nodes.select(F.col("id").alias(f"{s}_child_id"), F.col("height").alias(f"{s}_h"), F.col("level_index").alias(f"{s}_i"))
    x = nodes.join(child("left"), "left_child_id", "left").join(child("right"), "right_child_id", "left")
    codes = _coded(
        coord__leaf_height="left_child_id is null and right_child_id is null and height <> 0",
        coord__height_mismatch="height <> left_h + 1 or height <> right_h + 1",
        coord__level_index_mismatch="level_index <> floor(left_i / 2)",
        coord__left_child_odd="left_i % 2 <> 0",
        coord__right_child_even="right_i % 2 <> 1",
        coord__sibling_index="right_i <> left_i + 1",
    )
    return x.select("document_id", F.explode(codes).alias("code"), F.col("id").alias("node_id"))


def leaf_completeness(leaves: DataFrame) -> DataFrame:
    """Leaves without an embedding or without a preceding context (the first leaf needs none)."""
    codes = _coded(forest__no_embedding="embedding is null", forest__no_context="preceding_context is null and level_index > 0")
    return leaves.select("document_id", F.explode(codes).alias("code"), F.col("id").alias("node_id"))


def telemetry_findings(nodes: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Telemetry entries (document_id, entry, node_id, height, span) against the nodes of the same document.

    height and span come as text, as telemetry is read without a schema; an entry's first row of a node counts.
    """
    bad = telemetry.where("coalesce(node_id, '') = ''").select("document_id", F.lit("telemetry.node.missing_id").alias("code"), F.lit(None).cast("string").alias("node_id"))
    w = Window.partitionBy("document_id", "node_id").orderBy("entry")
    t = telemetry.where("coalesce(node_id, '') <> ''").withColumn("__k", F.row_number().over(w))
    twice = t.where("__k > 1").select("document_id", F.lit("telemetry.node.duplicate").alias("code"), "node_id")
    one = t.where("__k = 1").select("document_id", F.col("node_id").alias("id"), F.lit(True).alias("told"), F.col("height").alias("t_height"), F.expr("try_cast(height as int)").alias("t_h"), F.col("span").alias("t_span"), F.expr("try_cast(split(span, ',')[0] as bigint)").alias("t_a"), F.expr("try_cast(get(split(span, ','), 1) as bigint)").alias("t_b"))
    x = nodes.select("document_id", "id", F.lit(True).alias("stored"), "height", "span_start", "span_end").join(one, ["document_id", "id"], "full")
    codes = _coded(
        telemetry__node__missing="told is null",
        telemetry__node__unexpected="stored is null",
        telemetry__missing__height="told and stored and t_height is null",
        telemetry__invalid__height="told and stored and t_height is not null and t_h is null",
        telemetry__mismatch__height="told and stored and t_h <> height",
        telemetry__invalid__span="told and stored and t_span is not null and (t_a is null or t_b is null)",
        telemetry__mismatch__span="told and stored and (t_a <> span_start or t_b <> span_end)",
    )
    return bad.unionByName(twice).unionByName(x.select("document_id", F.explode(codes).alias("code"), F.col("id").alias("node_id")))


def report(nodes: DataFrame, findings: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row a document: status, findings, leaves without an embedding, nodes without a summary, pairs that could merge."""
    leaf = nodes.join(embedded.select("id", F.lit(True).alias("__e")), "id", "left")
    a = leaf.groupBy("document_id").agg(F.count("*").alias("n_nodes"), F.count_if((F.col("height") == 0) & F.col("__e").isNull()).alias("pending_embeddings"), F.count_if((F.col("height") > 0) & (F.col("token_count") == 0) & (F.col("span_end") > F.col("span_start"))).alias("pending_summaries"))
    pairs = nodes.where("parent_id is null").groupBy("document_id", "height").agg(F.floor(F.count("*") / 2).alias("p")).groupBy("document_id").agg(F.sum("p").alias("mergeable_pairs"))
    f = findings.groupBy("document_id").agg(F.count("*").alias("n_findings"))
    x = a.join(pairs, "document_id", "left").join(f, "document_id", "left").fillna(0, ["mergeable_pairs", "n_findings"])
    return x.withColumn("status", F.when(F.col("n_findings") > 0, "invalid").when(F.col("pending_embeddings") + F.col("pending_summaries") + F.col("mergeable_pairs") > 0, "incomplete").otherwise("complete"))


def text_coverage(leaves: DataFrame, lengths: DataFrame) -> DataFrame:
    """The first thing wrong with each document's leaves against its text's length: none, start, end, gap, or null."""
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index")
    x = leaves.withColumn("__after", F.lead("span_start").over(w))
    a = x.groupBy("document_id").agg(F.min("span_start").alias("lo"), F.max_by("span_end", F.struct("span_start", "level_index")).alias("hi"), F.count_if(F.col("__after") != F.col("span_end")).alias("gaps"))
    error = F.when(F.col("lo").isNull(), "no_leaves").when(F.col("lo") != 0, "start").when(F.col("hi") != F.col("len"), "end").when(F.col("gaps") > 0, "gap")
    return lengths.select("document_id", "len").join(a, "document_id", "left").select("document_id", error.alias("error"))


def chunk_report(leaves: DataFrame, target: int, tolerance: float = 0.2) -> DataFrame:
    """Leaves too large or too small for a target, by document; the last leaf may be small. A report, no finding."""
    lo, hi = int(target * (1 - tolerance)), int(target * (1 + tolerance))
    x = leaves.withColumn("__last", F.max("level_index").over(Window.partitionBy("document_id")) == F.col("level_index"))
    return x.groupBy("document_id").agg(F.count("*").alias("n_leaves"), F.count_if(F.col("token_count") > hi).alias("oversized"), F.count_if((F.col("token_count") < lo) & ~F.col("__last")).alias("undersized"))


def structure(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Empty spans, missing children, children that do not begin or end with their parent, and gaps between children that hold more than white space.

    Only documents with a gap have their text read.
    """
    child = lambda s: nodes.select(F.col("id").alias(f"{s}_child_id"), F.lit(True).alias(f"{s}_there"), F.col("span_start").alias(f"{s}_start"), F.col("span_end").alias(f"{s}_end"))
    x = nodes.join(child("left"), "left_child_id", "left").join(child("right"), "right_child_id", "left")
    codes = _coded(
        span__empty="span_start >= span_end",
        child__left_missing="left_child_id is not null and left_there is null",
        child__right_missing="right_child_id is not null and right_there is null",
        span__start="left_start <> span_start",
        span__end="right_end <> span_end",
    )
    out = x.select("document_id", F.explode(codes).alias("code"), F.col("id").alias("node_id"))
    gaps = x.where("left_end < right_start").select("document_id", "id", F.col("left_end").alias("a"), F.col("right_start").alias("b"))
    texts = docs.select(F.col("doc_id").alias("document_id"), "text").join(gaps.select("document_id").distinct(), "document_id", "left_semi")
    held = gaps.join(texts, "document_id").where(F.substring("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).rlike(r"\S"))
    return out.unionByName(held.select("document_id", F.lit("span.gap").alias("code"), F.col("id").alias("node_id")))


def uneven_trees(nodes: DataFrame) -> DataFrame:
    """Roots whose leaves are not 2 ** height: one row a tree that is not perfect, from the spans of leaf indexes alone."""
    leaf = nodes.where("height = 0").select("document_id", F.col("level_index").alias("li"))
    root = nodes.where("parent_id is null and height > 0")
    tops = root.groupBy("document_id").agg(F.max("height").alias("top"))
    up = leaf.join(tops, "document_id").select("document_id", "li", F.explode(F.sequence(F.lit(1), "top")).alias("height")).groupBy("document_id", "height", F.floor(F.col("li") / F.pow(F.lit(2.0), F.col("height"))).alias("level_index")).agg(F.count("*").alias("n"))
    x = root.join(up, ["document_id", "height", "level_index"], "left")
    return _found(x.where("coalesce(n, 0) <> pow(2, height)"), "tree.uneven")


def tiling_report(tiling: DataFrame, lengths: DataFrame, budget: int) -> DataFrame:
    """Of each document's tiling: whether it covers the text once, in order, within a budget."""
    w = Window.partitionBy("document_id").orderBy("span_start", "span_end")
    x = tiling.withColumn("before", F.lag("span_end").over(w))
    a = x.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.min("span_start").alias("lo"), F.max("span_end").alias("hi"), F.count_if(F.col("before") > F.col("span_start")).alias("overlaps"), F.count_if(F.col("before") < F.col("span_start")).alias("gaps"))
    return lengths.join(a, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce((F.col("lo") == 0) & (F.col("hi") == F.col("len")) & (F.col("overlaps") == 0) & (F.col("gaps") == 0), F.lit(False)).alias("covers"), (F.coalesce("tokens", F.lit(0)) > budget).alias("over_budget"))
