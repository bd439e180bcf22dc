"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant, the others as named users, and system turns as system. A turn is

    <|assistant|>\\n TEXT <|end|>\\n      <|user:NAME|>\\n TEXT <|end|>\\n      <|system|>\\n TEXT <|end|>\\n

(without the spaces), and the loss mask covers TEXT<|end|> of the assistant's turns. `<|` inside a text or
a name is written `<||`, which can be undone, so a text cannot forge a turn. A dialogue is cut into
segments of SEGMENT_TURNS turn numbers; nearly all have one. Texts of the segments joined in order are the
dialogue, and offsets count from its start, so no dialogue needs to fit into one task.

Rules. Turns sort by (turn, speaker, text), nulls first; repeated rows stay, each as a turn. A null text is
empty. A null speaker is rendered as user `unknown` and is no participant; system is no participant. A
conversation without participants gives no rows. Null conversation ids are one conversation. Extra columns
are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 1024


def escape(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<||"))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, perspective, segment, n_turns, n_own, start, text and mask (start, end), one row per segment."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(speaker_col).alias("speaker"), F.col(text_col).alias("text"))
    t = t.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).cast("long"))
    head = F.when(F.col("speaker") == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), escape(F.coalesce("speaker", F.lit("unknown"))), F.lit("|>\n")))
    body = F.concat(escape(F.col("text")), F.lit("<|end|>"))
    parts = t.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text", head.alias("head"), body.alias("body")))).alias("turns"))
    people = t.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    joined = parts.alias("s").join(people.alias("p"), F.col("s.conv_id").eqNullSafe(F.col("p.conv_id"))).select("s.*", "perspective")
    own = lambda x: F.coalesce(x["speaker"] == F.col("perspective"), F.lit(False))
    top = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).otherwise(x["head"])
    joined = joined.withColumn("text", F.array_join(F.transform("turns", lambda x: F.concat(top(x), x["body"], F.lit("\n"))), ""))
    spans = "array<struct<start:long,end:long>>"

    def step(acc, x):
        start = acc["at"] + F.length(top(x))
        end = start + F.length(x["body"])
        return F.struct((end + 1).alias("at"), F.when(own(x), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("out"))
    joined = joined.withColumn("mask", F.aggregate("turns", zero, step, lambda acc: acc["out"]))
    before = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("start", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0).cast("long")))
    return joined.select(
        "conv_id", "perspective", "segment", F.size("turns").cast("long").alias("n_turns"), F.size("mask").cast("long").alias("n_own"), "start", "text",
        F.transform("mask", lambda m: F.struct((m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end"))).alias("mask"),
    )
