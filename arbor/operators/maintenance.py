"""Bulk changes of nodes, units and vectors, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOPS = 20


def bulk_update(rows: DataFrame, changes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """The column takes the value of changes, where they have one for the key that is not null."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def relink(nodes: DataFrame) -> DataFrame:
    """Neighbour links anew from the coordinates; a gap in the indexes ends a chain."""
    w = Window.partitionBy("document_id", "height").orderBy("level_index")
    near = lambda f, k: F.when(f("level_index").over(w) == F.col("level_index") + k, f("id").over(w))
    return nodes.withColumn("preceding_neighbor_id", near(F.lag, -1)).withColumn("following_neighbor_id", near(F.lead, 1))


def truncate_by_time(units: DataFrame, latest: float) -> DataFrame:
    """Deletes units that end after a time (none without a time) and closes the gaps: spans move left by what went before them."""
    gone = F.coalesce(F.col("time_end") > latest, F.lit(False))
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.when(gone, F.col("span_end") - F.col("span_start"))).over(w), F.lit(0))
    moved = units.withColumn("__gone", gone).withColumn("__shift", shift).where("not __gone")
    return moved.withColumn("span_start", F.col("span_start") - F.col("__shift")).withColumn("span_end", F.col("span_end") - F.col("__shift")).drop("__gone", "__shift")


def delete_vectors(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.join(ids.select(key).distinct(), key, "left_anti")


def repair_times(units: DataFrame, hops: int = HOPS) -> DataFrame:
    """Missing or zero times lie between the end of the last valid unit before and the start of the next, within some hops.

    Where one side has none the other gives both; where both have none, the times are null.
    """
    w = Window.partitionBy("document_id").orderBy("level_index")
    valid = lambda c: F.when(F.col(c) != 0, F.col(c))
    before = F.last(valid("time_end"), ignorenulls=True).over(w.rowsBetween(-hops, -1))
    after = F.first(valid("time_start"), ignorenulls=True).over(w.rowsBetween(1, hops))
    bad = valid("time_start").isNull() | valid("time_end").isNull()
    x = units.withColumn("__b", before).withColumn("__a", after).withColumn("repaired", bad)
    return x.withColumn("time_start", F.when(bad, F.coalesce("__b", "__a")).otherwise(F.col("time_start"))).withColumn("time_end", F.when(bad, F.coalesce("__a", "__b")).otherwise(F.col("time_end"))).drop("__a", "__b")


def health(nodes: DataFrame, times: Column) -> DataFrame:
    """Counts of nodes without a time, and of nodes whose parent is gone."""
    ids = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("__there"))
    x = nodes.withColumn("__t", times).join(ids, "parent_id", "left")
    return x.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("__t"), F.lit(0)) == 0).alias("no_time"), F.count_if(F.col("parent_id").isNotNull() & F.col("__there").isNull()).alias("orphans"))


def prune_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Deletes the named nodes above height 0 that have no parent; their children become roots, links to them end."""
    gone = nodes.where("parent_id is null and height > 0").join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("__id"))
    out = nodes.join(gone, nodes["id"] == F.col("__id"), "left_anti")
    for c in ("parent_id", "preceding_neighbor_id", "following_neighbor_id"):
        g = gone.select(F.col("__id").alias(f"__{c}"))
        out = out.join(g, F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.when(F.col(f"__{c}").isNull(), F.col(c))).drop(f"__{c}")
    return out


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that two snapshots do not share or that differ in a column: added, removed or changed."""
    h = lambda df, n: df.select(key, F.struct(*columns).alias(n))
    x = h(before, "b").join(h(after, "a"), key, "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return x.select(key, kind.alias("kind")).where("kind is not null")


def char_chunks(docs: DataFrame, parts: int) -> DataFrame:
    """Up to `parts` pieces of equal length (the last is shorter) of every text; null and empty texts have none."""
    n = F.length("text")
    size = F.ceil(n / parts).cast("int")
    x = docs.where(n > 0).withColumn("__size", size).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)))
    return x.withColumn("chunk", F.expr("substring(text, part * __size + 1, __size)")).drop("__size")


def adjacent(units: DataFrame) -> DataFrame:
    """Each unit with the ids before and after it."""
    w = Window.partitionBy("document_id").orderBy("level_index")
    return units.withColumn("before", F.lag("level_index").over(w)).withColumn("after", F.lead("level_index").over(w))


def passthrough(tokens: Column, height: Column, least: int = 50) -> Column:
    """Target of a parent's summary: its span's share of 2 ** -height, 0 (no summary) below `least`."""
    t = F.floor(tokens / F.pow(F.lit(2.0), height))
    return F.when(t < least, 0).otherwise(t).cast("bigint")


def eligible_pairs(roots: DataFrame, most_difference: int | None = None) -> DataFrame:
    """Adjacent roots of one height, the left with an even index, that may merge.

    With a bound, the parent may be at most so much higher than the lowest root up to and with the left one.
    """
    w = Window.partitionBy("document_id").orderBy("span_start", "level_index")
    low = F.min("height").over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = lambda c: F.lead(c).over(w)
    x = roots.withColumn("__low", low).withColumn("right_id", nxt("id")).withColumn("__h", nxt("height")).withColumn("__i", nxt("level_index"))
    ok = (F.col("__h") == F.col("height")) & (F.col("level_index") % 2 == 0) & (F.col("__i") == F.col("level_index") + 1)
    if most_difference is not None:
        ok = ok & (F.col("height") + 1 - F.col("__low") <= most_difference)
    return x.where(ok).select("document_id", F.col("id").alias("left_id"), "right_id", "height")
