"""The query path: requests, candidates, windowed coverage, scores of seeds and siblings, and sizes of a result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K
from arbor.operators.navigation import window_bounds
from arbor.operators.retrieval import dot


def request_mode(budget: Column, seeds: Column) -> Column:
    """budget, budget+seeds, seeds or structure (seeds = 0: nothing is searched, all scores are 0); a request with neither raises."""
    none = F.raise_error(F.lit("a request needs a budget or a number of seeds")).cast("string")
    named = F.when(budget.isNotNull() & seeds.isNotNull(), "budget+seeds").when(budget.isNotNull(), "budget").when(seeds.isNotNull(), "seeds").otherwise(none)
    return F.when(seeds == 0, "structure").otherwise(named)


def window_error(start: Column, end: Column, length: Column) -> Column:
    """What is wrong with a window of a document, or null."""
    return F.when(start >= end, "window.empty").when(start >= length, "window.outside").when(start < 0, "window.negative")


def candidate_count(seeds: Column, multiplier: float) -> Column:
    return F.floor(seeds * multiplier).cast("bigint")


def searchable(leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """Leaves of each request's document that overlap its window and end before its horizon (null: none).

    requests: query_id, document_id, start, end, horizon.
    """
    x = leaves.join(requests, "document_id")
    inside = (F.col("span_start") < F.col("end")) & (F.col("span_end") > F.col("start"))
    return x.where(inside & F.coalesce(F.col("span_end") <= F.col("horizon"), F.lit(True)))


def leaf_window(requests: DataFrame, chunk: int) -> DataFrame:
    """(.., lo, hi): windows of characters snapped to the leaves of `chunk` characters that hold their first and last character."""
    return requests.withColumn("lo", F.floor(F.col("start") / chunk)).withColumn("hi", F.floor((F.col("end") - 1) / chunk))


def _upwards(seeds: DataFrame) -> DataFrame:
    """Coordinates of seeds, their ancestors up to top and the siblings of all: query_id, document_id, height, level_index."""
    s = seeds.select("query_id", "document_id", F.explode(F.sequence(F.col("height").cast("int"), F.col("top").cast("int"))).alias("h"), "height", "level_index")
    up = s.select("query_id", "document_id", F.col("h").alias("height"), K.ancestor_index(F.col("height"), F.col("level_index"), F.col("h")).alias("level_index"))
    return up.unionByName(up.withColumn("level_index", K.sibling(F.col("level_index"))))


def windowed_coverage(seeds: DataFrame, nodes: DataFrame, windows: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Nodes of each query's coverage inside its window of leaves (query_id, document_id, lo, hi).

    Seeds (query_id, document_id, height, level_index) and the highest nodes at both edges of the window go up
    with their ancestors and siblings; the roots of the document join them; ancestors of pinned nodes go, so that these are
    roots of their own; what has a leaf outside the window goes. All of it is arithmetic on coordinates: an explode
    over heights, one distinct, one anti-join with the pinned and one join with the nodes.
    """
    tops = nodes.groupBy("document_id").agg(F.max("height").alias("top"))
    w = windows.join(tops, "document_id")
    b = window_bounds(w)
    edges = [b.select("query_id", "document_id", F.col(f"{side}_height").cast("int").alias("height"), F.col(f"{side}_index").alias("level_index"), "top") for side in ("left", "right")]
    own = seeds.join(w.select("query_id", "top"), "query_id").select("query_id", "document_id", F.col("height").cast("int").alias("height"), "level_index", "top")
    all_up = _upwards(own.unionByName(edges[0]).unionByName(edges[1]))
    roots = nodes.where("parent_id is null").select("document_id", "height", "level_index").join(windows.select("query_id", "document_id"), "document_id").select(*all_up.columns)
    coords = all_up.unionByName(roots).distinct()
    if pinned is not None:
        p = pinned.join(tops, "document_id").where("height < top")
        above = p.select("query_id", F.explode(F.sequence((F.col("height") + 1).cast("int"), F.col("top").cast("int"))).alias("h"), "height", "level_index")
        above = above.select("query_id", F.col("h").alias("height"), K.ancestor_index(F.col("height"), F.col("level_index"), F.col("h")).alias("level_index")).distinct()
        coords = coords.join(above, ["query_id", "height", "level_index"], "left_anti")
    inside = coords.join(windows.select("query_id", "lo", "hi"), "query_id").where(K.within(F.col("height"), F.col("level_index"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return inside.join(nodes, ["document_id", "height", "level_index"])


def complete_coverage(seeds: DataFrame, nodes: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Coverage with the whole document as window."""
    last = nodes.where("height = 0").groupBy("document_id").agg(F.max("level_index").alias("hi"))
    windows = seeds.select("query_id", "document_id").distinct().join(last, "document_id").withColumn("lo", F.lit(0).cast("bigint"))
    return windowed_coverage(seeds, nodes, windows, pinned)


def seed_scores(candidates: DataFrame, cover: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of the candidates in coverage and of their siblings in coverage: dot products clipped to 0..1.

    Every candidate in coverage counts as a seed. candidates: query_id, id; vectors: id, vec; queries: query_id, qvec.
    """
    here = cover.select("query_id", "id", "parent_id")
    own = here.join(candidates.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    beside = here.join(own.where("parent_id is not null").select("query_id", "parent_id").distinct(), ["query_id", "parent_id"], "left_semi")
    asked = own.select("query_id", "id").unionByName(beside.select("query_id", "id")).distinct()
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("vec"), F.col("qvec"))))
    return asked.join(vectors, "id").join(queries, "query_id").select("query_id", "id", score.alias("score"))


def tiling_mass(tiles: DataFrame) -> DataFrame:
    """Nodes, tokens and score mass of each query's tiling."""
    return tiles.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.sum("token_count").alias("tokens"), F.sum(F.coalesce("score", F.lit(0.0)) * F.col("token_count")).alias("mass"))


def _fitting(budget: int):
    def run(batches):
        doc, left = None, budget
        for b in batches:
            take = []
            for i, (d, size) in enumerate(zip(b["document_id"].to_pylist(), b["token_count"].to_pylist())):
                if d != doc:
                    doc, left = d, budget
                if 0 < budget and size <= left:
                    left -= size
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    return run


def verbatim_leaves(leaves: DataFrame, budget: int) -> DataFrame:
    """Leaves from the right end that fit into what is left of a budget, those too large skipped; with the horizon where they begin.

    A document's leaves pass in order as a stream that carries what is left, so none is held whole; a leaf without a document or
    a size is left out.
    """
    x = leaves.where("document_id is not null and token_count is not null").select("document_id", "id", "token_count", "span_start", "span_end", "level_index")
    order = ["document_id", F.desc("span_end"), F.desc("level_index")]
    got = x.repartition("document_id").sortWithinPartitions(*order).mapInArrow(_fitting(budget), x.schema)
    return got.select("document_id", F.min("span_start").over(Window.partitionBy("document_id")).alias("horizon"), "id")


def token_positions(nodes: DataFrame) -> DataFrame:
    """(id, token_start, token_end) on the axis of a document's leaf tokens: running sums at the first and last leaf of each node."""
    w = Window.partitionBy("document_id").orderBy("level_index").rowsBetween(Window.unboundedPreceding, 0)
    at = nodes.where("height = 0").select("document_id", "level_index", F.sum("token_count").over(w).alias("end"), "token_count")
    first, last = K.first_leaf(F.col("height"), F.col("level_index")), K.last_leaf(F.col("height"), F.col("level_index"))
    lo = at.select("document_id", F.col("level_index").alias("first"), (F.col("end") - F.col("token_count")).alias("token_start"))
    hi = at.select("document_id", F.col("level_index").alias("last"), F.col("end").alias("token_end"))
    return nodes.select("document_id", "id", first.alias("first"), last.alias("last")).join(lo, ["document_id", "first"]).join(hi, ["document_id", "last"]).select("id", "token_start", "token_end")
