"""Robust statistics, journal folding and transcript graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.operators.metrics import linear_quantiles, positions, values_at
from arbor.session import ensure_checkpoint_dir


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, quartiles, p95 (linear), median absolute deviation, sample and population deviation; quantiles by ranges of values, so that no key is one task."""
    v = F.col(value)
    a = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.stddev_pop(v).alias("pstd"))
    q = linear_quantiles(positions(df, keys, value), keys, value, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95})
    away = df.join(q.select(*keys, F.col("median").alias("__m")), keys).withColumn("__away", F.abs(v - F.col("__m")))
    mad = linear_quantiles(positions(away, keys, "__away"), keys, "__away", {"mad": 0.5})
    return a.join(q, keys).join(mad, keys).withColumn("iqr", F.col("p75") - F.col("p25"))


def quantile_exclusive(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Quantile at position q * (n + 1) of the ordered values, between neighbours, clipped to the ends."""
    pos = F.greatest(F.lit(1.0), F.least(F.col("total").cast("double"), q * (F.col("total") + 1)))
    x = values_at(positions(df, keys, value), keys, value, a=F.floor(pos), b=F.ceil(pos))
    return x.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (pos - F.floor(pos))).alias("quantile"))


def quantile_nearest(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at index int(n * q) of the ordered values."""
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * q)) + 1
    return values_at(positions(df, keys, value), keys, value, quantile=at).drop("total")


def fold_journal(journal: DataFrame) -> DataFrame:
    """One row an append key: first start, last end and its outcome, commits."""
    started, ended = F.col("event") == "append_started", F.col("event").isin("append_completed", "append_failed")
    order = F.struct("ts", "event_id")
    a = journal.groupBy("append_id").agg(F.min(F.when(started, order)).alias("s"), F.max(F.when(ended, F.struct("ts", "event_id", "event"))).alias("e"), F.count_if(F.col("event") == "node_committed").alias("commits"), F.count("*").alias("n"))
    return a.select("append_id", F.col("s.event_id").alias("first_start"), F.col("e.event_id").alias("last_end"), F.coalesce("e.event", F.lit("running")).alias("outcome"), "commits", "n")


def fold_nodes(commits: DataFrame) -> DataFrame:
    """One row a node of commits (node_id, event_id, ts, height, span_start, span_end): the first time it was created, its last height and span."""
    order = F.struct("ts", "event_id")
    return commits.groupBy("node_id").agg(F.min("ts").alias("created_at"), F.max_by(F.struct("height", "span_start", "span_end"), order).alias("l"), F.count("*").alias("n_commits")).select("node_id", "created_at", "l.*", "n_commits")


def append_history(journal: DataFrame) -> DataFrame:
    """Finished runs: when first seen (event id), last status, last start and last end."""
    order = F.struct("ts", "event_id")
    own = journal.where(F.col("event").isin("append_started", "append_completed", "append_failed"))
    ended = F.col("event") != "append_started"
    a = own.groupBy("append_id").agg(F.min_by("event_id", order).alias("first_seen"), F.max_by("event", order).alias("last"), F.max(F.when(~ended, F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("ended_at"))
    status = F.when(F.col("last") == "append_completed", "completed").when(F.col("last") == "append_failed", "failed")
    return a.withColumn("status", status).where("status is not null").drop("last")


def bridge(records: DataFrame) -> DataFrame:
    """Records without a parent hang on the record before them in file order."""
    w = Window.partitionBy("session").orderBy("line")
    return records.withColumn("parent", F.coalesce("parent", F.lag("uuid").over(w)))


def head(records: DataFrame) -> DataFrame:
    return records.groupBy("session").agg(F.max_by("uuid", "line").alias("head"))


def chain(records: DataFrame, max_steps: int = 64, starts: DataFrame | None = None) -> DataFrame:
    """(session, uuid, depth) from each session's start (its head, if none is given) to its root, by doubling: log2 of the depth joins.

    step leads 2^k records up after k rounds. Cycles end because a chain is no longer than its session.
    """
    ensure_checkpoint_dir(records.sparkSession)
    records = records.select("session", "uuid", "parent", "line").checkpoint()
    step, k = records.select("session", "uuid", F.col("parent").alias("to")), 0
    first = head(records).select("session", F.col("head").alias("uuid")) if starts is None else starts.select("session", "uuid")
    have = first.withColumn("depth", F.lit(0).cast("bigint"))
    total = records.groupBy("session").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while (1 << k) <= total and k < max_steps:
        moved = have.join(step, ["session", "uuid"]).where("to is not null").select("session", F.col("to").alias("uuid"), (F.col("depth") + (1 << k)).alias("depth"))
        have = have.unionByName(moved).checkpoint()
        nxt = step.select(F.col("session").alias("s2"), F.col("uuid").alias("mid"), F.col("to").alias("to2"))
        step = step.join(nxt, (F.col("session") == F.col("s2")) & (F.col("to") == F.col("mid"))).select("session", "uuid", F.col("to2").alias("to")).checkpoint()
        k += 1
    return have


def common_ancestor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two chains a session: the first record both have, and its depths."""
    x = a.join(b.select("session", "uuid", F.col("depth").alias("depth_b")), ["session", "uuid"])
    return x.groupBy("session").agg(F.min_by("uuid", "depth").alias("uuid"), F.min("depth").alias("depth_a"), F.min_by("depth_b", "depth").alias("depth_b"))


def sync_plan(chains: DataFrame, records: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What to append after a cutoff time, and where the indexed part must be cut.

    The truncation point is the nearest ancestor not after the cutoff; what is above it in the chain is new.
    kind: none if the record at the cutoff is still on the chain, full if no ancestor is old enough, else partial.
    Late records, not after the cutoff and off the chain, count as indexed.
    """
    x = chains.join(records.select("session", "uuid", "ts"), ["session", "uuid"]).join(cutoffs.select("session", "cutoff"), "session")
    old = F.col("ts") <= F.col("cutoff")
    a = x.groupBy("session").agg(F.min(F.when(old, F.struct("depth", "uuid", (F.col("ts") == F.col("cutoff")).alias("same")))).alias("p"), F.count("*").alias("n"))
    return a.select("session", F.col("p.uuid").alias("truncate_at"), F.coalesce("p.depth", "n").alias("n_new"), F.when(F.col("p").isNull(), "full").when(F.col("p.same"), "none").otherwise("partial").alias("kind"))


def turns(records: DataFrame) -> DataFrame:
    """A user record begins a turn; records before the first are dropped."""
    w = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = records.withColumn("turn", F.sum(F.col("is_user").cast("bigint")).over(w)).where("turn > 0")
    return t.groupBy("session", "turn").agg(F.count("*").alias("n"), F.min_by("uuid", "line").alias("first_uuid"), F.max_by("uuid", "line").alias("last_uuid"))


def token_f1(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """F1 of the multisets of words of two texts."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: w != "")
    count = lambda c, n: pairs.select(key, F.explode(words(c)).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    both = count(a, "na").join(count(b, "nb"), [key, "w"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("same"), F.sum("na").alias("la"), F.sum("nb").alias("lb"))
    return both.select(key, F.when(F.col("same") == 0, 0.0).otherwise(2.0 * F.col("same") / (F.col("la") + F.col("lb"))).alias("f1"))


def cost(prompt: Column, cached: Column, completion: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """Dollars of a call, prices for a million tokens."""
    return ((prompt - cached) * price_in + cached * price_cached + completion * price_out) / 1e6
