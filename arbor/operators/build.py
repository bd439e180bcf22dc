"""Building trees: text clean-up, units, appends, parents, contexts, batches, and what a synchronisation has to do."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from arbor.sources.corpus import token_count

_PARAGRAPH = "\ue000"


def join_lines(text: Column) -> Column:
    """Line ends inside sentences become blanks; those after . ! ? and between paragraphs stay."""
    kept = F.replace(text, F.lit("\n\n"), F.lit(_PARAGRAPH))
    return F.replace(F.regexp_replace(kept, "([^.!?\n])\n", "$1 "), F.lit(_PARAGRAPH), F.lit("\n\n"))


def iso_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time with a zone; anything else raises, null stays null."""
    zoned = c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    bad = F.raise_error(F.concat(F.lit("no time with a zone: "), c)).cast("double")
    return F.when(c.isNull(), F.lit(None)).when(zoned, F.unix_micros(F.to_timestamp(c)) / 1e6).otherwise(bad)


def parse_units(units: DataFrame) -> DataFrame:
    """Units with times in seconds: one of two times, or an end before its start, raises."""
    one = F.col("time_start").isNull() != F.col("time_end").isNull()
    t = units.withColumn("time_end", F.when(one, F.raise_error(F.lit("both times or none")).cast("double")).otherwise(iso_seconds(F.col("time_end")))).withColumn("time_start", iso_seconds(F.col("time_start")))
    return t.withColumn("time_end", F.when(F.col("time_end") < F.col("time_start"), F.raise_error(F.lit("a unit ends before it starts")).cast("double")).otherwise(F.col("time_end")))


def append(leaves: DataFrame, units: DataFrame) -> DataFrame:
    """New leaves for units (document_id, unit_no, n_chars, time_start, time_end), after the leaves that each document has.

    The first append says whether a document has times; a later unit of the other kind raises.
    """
    state = leaves.groupBy("document_id").agg(F.max("span_end").alias("__end"), (F.max("level_index") + 1).alias("__n"), F.max(F.col("time_start").isNotNull()).alias("__timed"))
    w = Window.partitionBy("document_id").orderBy("unit_no")
    x = units.withColumn("__upto", F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__k", F.row_number().over(w) - 1).withColumn("__own", F.first(F.col("time_start").isNotNull()).over(w)).join(state, "document_id", "left")
    same = F.col("time_start").isNotNull() == F.coalesce("__timed", "__own")
    end = F.coalesce("__end", F.lit(0).cast("bigint")) + F.when(same, F.col("__upto")).otherwise(F.raise_error(F.lit("units with and without times in one document")).cast("bigint"))
    return x.select("document_id", (F.coalesce("__n", F.lit(0)) + F.col("__k")).cast("bigint").alias("level_index"), (end - F.col("n_chars")).alias("span_start"), end.alias("span_end"), token_count(F.col("n_chars")).alias("token_count"), "time_start", "time_end")


def _parent_tokens(start: Column, end: Column, height: Column) -> Column:
    return F.floor(token_count(end - start) / F.pow(F.lit(2.0), height)).cast("bigint")


def parents(leaves: DataFrame, max_height: int = 40) -> DataFrame:
    """All nodes above leaves whose leaves are all there: spans and times from the first leaf's start to the last leaf's end.

    One aggregate over (document, height, index) instead of a loop over heights; partial sums shrink it before the shuffle.
    """
    n = leaves.groupBy("document_id").agg(F.count("*").alias("__n"))
    h = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_height), F.length(F.bin("__n")) - 1)))
    x = leaves.join(n.where("__n > 1"), "document_id").withColumn("height", h)
    x = x.withColumn("p", F.floor(F.col("level_index") / F.pow(F.lit(2.0), F.col("height"))).cast("bigint"))
    a = x.groupBy("document_id", "height", F.col("p").alias("level_index")).agg(F.count("*").alias("n"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.min(F.struct("level_index", "time_start")).alias("a"), F.max(F.struct("level_index", "time_end")).alias("b"))
    whole = a.where(F.col("n") == F.pow(F.lit(2.0), F.col("height")))
    return whole.select("document_id", "height", "level_index", "span_start", "span_end", _parent_tokens(F.col("span_start"), F.col("span_end"), F.col("height")).alias("token_count"), F.col("a.time_start").alias("time_start"), F.col("b.time_end").alias("time_end"))


def new_parents(fresh: DataFrame, leaves: DataFrame) -> DataFrame:
    """Nodes that new leaves complete: for each leaf the heights at which it is a last leaf, joined with the first leaf there.

    leaves has the stored and the new ones; no other node is read, and a leaf completes one node on average.
    """
    last = F.col("level_index") + 1
    up = fresh.withColumn("height", F.explode(F.filter(F.sequence(F.lit(0), F.length(F.bin(last))), lambda h: (h > 0) & (last % F.pow(F.lit(2.0), h).cast("bigint") == 0))))
    width = F.pow(F.lit(2.0), F.col("height")).cast("bigint")
    up = up.select("document_id", "height", (F.floor(last / width) - 1).cast("bigint").alias("level_index"), (last - width).alias("first"), "span_end", "time_end")
    lo = leaves.select("document_id", F.col("level_index").alias("first"), "span_start", "time_start")
    x = up.join(lo, ["document_id", "first"])
    return x.select("document_id", "height", "level_index", "span_start", "span_end", _parent_tokens(F.col("span_start"), F.col("span_end"), F.col("height")).alias("token_count"), "time_start", "time_end")


def context_prefix(context: Column, context_tokens: Column, leaf_tokens: Column, limit: int) -> Column:
    """What of a context stands before a leaf of an embedding text: at most limit - leaf - 1 tokens (four characters each), cut at its beginning; empty if no room is left."""
    room = F.lit(limit) - leaf_tokens - 1
    n = F.length(context)
    cut = F.when(context_tokens <= room, context).otherwise(F.substring(context, F.greatest(F.lit(1), n - room * 4 + 1).cast("int"), (room * 4).cast("int")))
    return F.when((room <= 0) | context.isNull() | (F.trim(cut) == ""), F.lit("")).otherwise(cut)


def embedding_text(context: Column, context_tokens: Column, leaf: Column, leaf_tokens: Column, limit: int) -> Column:
    """Context, line end, leaf; the leaf alone where no context fits."""
    p = context_prefix(context, context_tokens, leaf_tokens, limit)
    return F.when(p == "", leaf).otherwise(F.concat(p, F.lit("\n"), leaf))


def _batch_numbers(key: str, tokens: str, most_items: int, most_tokens: int):
    def run(parts):
        now, batch, n, total, first = None, 0, 0, 0, True
        for p in parts:
            numbers = []
            for k, t in zip(p[key].to_pylist(), p[tokens].to_pylist()):
                t = t or 0
                if first or k != now:
                    now, batch, n, total, first = k, 0, 1, t, False
                elif n >= most_items or total + t > most_tokens:
                    batch, n, total = batch + 1, 1, t
                else:
                    n, total = n + 1, total + t
                numbers.append(batch)
            yield pa.record_batch([*p.columns, pa.array(numbers, pa.int32())], [*p.schema.names, "batch"])

    return run


def batches(items: DataFrame, key: str, order: str, tokens: str, most_items: int, most_tokens: int) -> DataFrame:
    """Adds batch: consecutive items of a key in batches of at most so many items and, beyond one item, so many tokens (null: none).

    A key's items pass in order as a stream that carries the open batch, so no key is held whole; rows without a key are one key.
    """
    schema = StructType([*items.schema.fields, StructField("batch", IntegerType())])
    return items.repartition(key).sortWithinPartitions(key, order).mapInArrow(_batch_numbers(key, tokens, most_items, most_tokens), schema)


def better_summary(new: Column, best: Column, target: Column) -> Column:
    """Whether a summary of `new` tokens replaces one of `best`: within the target before beyond it, then longer within, shorter beyond."""
    return F.when((new <= target) & (best > target), True).when((new <= target) & (best <= target), new > best).when((new > target) & (best > target), new < best).otherwise(False)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt of each node that no later one replaces: the order of better_summary as a sort key; of equal ones the first."""
    a, t = F.col("actual_tokens"), F.col("target_tokens")
    key = F.struct((a <= t).alias("fits"), F.when(a <= t, a).otherwise(-a).alias("size"), (-F.col("attempt")).alias("early"))
    return attempts.groupBy("node_id").agg(F.max_by(F.struct("attempt", "actual_tokens"), key).alias("b")).select("node_id", "b.*")


def words_for(tokens: Column) -> Column:
    """Words to ask for, given a target in tokens: three quarters of a word a token, less six in a hundred."""
    return F.round(tokens * 0.75 * 0.94).cast("bigint")


def sync_actions(indexed: DataFrame, log: DataFrame) -> DataFrame:
    """(session, uuid, action) from what is indexed and what the log holds, both (session, uuid, ts).

    An indexed record that the log no longer has is a revert: it and what is indexed from its time on is `delete`d. What stays
    is `keep`; its latest time is the high-water mark: later records of the log are `append`ed, and others that are not
    indexed are `late` and stay out, as there is no watermark that would let them in.
    """
    lost = indexed.join(log.select("session", "uuid"), ["session", "uuid"], "left_anti").groupBy("session").agg(F.min("ts").alias("__cut"))
    x = indexed.join(lost, "session", "left").withColumn("action", F.when(F.col("ts") >= F.col("__cut"), "delete").otherwise("keep"))
    keep = x.where("action = 'keep'")
    mark = keep.groupBy("session").agg(F.max("ts").alias("__mark"))
    fresh = log.join(keep.select("session", "uuid"), ["session", "uuid"], "left_anti").join(mark, "session", "left")
    new = fresh.withColumn("action", F.when(F.col("__mark").isNull() | (F.col("ts") > F.col("__mark")), "append").otherwise("late"))
    return x.select("session", "uuid", "action").unionByName(new.select("session", "uuid", "action"))
