"""Statistics of summary attempts, strategies, verdicts and phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted_attempts(attempts: DataFrame) -> DataFrame:
    """The accepted attempt of every node, the last one where the accepted index is out of range."""
    row = F.struct(*[c for c in attempts.columns if c != "node_id"])
    best = F.max_by(row, F.struct(F.coalesce(F.col("attempt") == F.col("accepted"), F.lit(False)), F.col("attempt")))
    return attempts.groupBy("node_id").agg(best.alias("a")).select("node_id", "a.*")


def target_groups(attempts: DataFrame) -> DataFrame:
    """Fit of the accepted attempts by target; nodes whose accepted index is out of range drop out."""
    x = attempts.where("attempt = accepted and target_tokens > 0").withColumn("d", (F.col("actual_tokens") - F.col("target_tokens")) / F.col("target_tokens") * 100)
    within = [F.avg((F.abs("d") <= k).cast("double")).alias(f"within_{k}") for k in (5, 10, 20, 50)]
    return x.groupBy("target_tokens").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg(F.abs("d")).alias("mean_abs"), F.greatest(F.lit(0.0), F.max("d")).alias("overshoot"), F.greatest(F.lit(0.0), F.max(-F.col("d"))).alias("undershoot"), *within)


def retries(attempts: DataFrame) -> DataFrame:
    """Nodes by number of retries: 0, 1, 2, 3 and more."""
    n = attempts.groupBy("node_id").agg((F.count("*") - 1).alias("n"))
    return n.groupBy(F.least("n", F.lit(3)).alias("retries")).agg(F.count("*").alias("n_nodes"))


def latencies(attempts: DataFrame) -> DataFrame:
    """Last end less first start of every node; starts of 0 are unknown, as are nodes without another."""
    t = attempts.groupBy("node_id").agg((F.max("end_time") - F.min(F.when(F.col("start_time") > 0, F.col("start_time")))).alias("latency"))
    return t.where("latency is not null")


def verbatim_by_height(accepted: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Nodes, and those whose summary is as long as its input, by height."""
    same = F.abs(F.col("actual_tokens") / F.col("prompt_tokens") - 1) <= tolerance
    return accepted.where("prompt_tokens > 0").groupBy("height").agg(F.count("*").alias("n"), F.count_if(same).alias("verbatim"))


def per_height(accepted: DataFrame) -> DataFrame:
    """Nodes of every height from 0 to the highest, zeros included."""
    n = accepted.groupBy("height").agg(F.count("*").alias("n"))
    every = n.agg(F.max("height").cast("int").alias("h")).select(F.explode(F.sequence(F.lit(0), F.col("h"))).alias("height"))
    return every.join(n, "height", "left").select("height", F.coalesce("n", F.lit(0)).alias("n"))


def strategies(results: DataFrame, keys: list[str]) -> DataFrame:
    """Deviation in percent by keys: mean, median, mean of absolutes, population deviation, shares within 10 and 20."""
    d = F.col("deviation")
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.avg(F.abs(d)).alias("mean_abs"), F.stddev_pop(d).alias("pstd"), F.avg((F.abs(d) <= 10).cast("double")).alias("within_10"), F.avg((F.abs(d) <= 20).cast("double")).alias("within_20"), (100 / (100 + F.avg(d))).alias("compensation"))


def size_bucket(column: str):
    c = F.col(column)
    return F.when(c < 250, "<250").when(c < 450, "<450").when(c < 750, "<750").when(c < 1200, "<1200").otherwise("1200+")


def pivot_mean(df: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def compare(baseline: DataFrame, current: DataFrame, key: str, value: str, threshold: float = 0.5) -> DataFrame:
    """Relative change of the keys that both have, and whether it is a regression."""
    x = baseline.select(key, F.col(value).alias("was")).join(current.select(key, F.col(value).alias("now")), key)
    return x.withColumn("change", F.when(F.col("was") != 0, (F.col("now") - F.col("was")) / F.col("was"))).withColumn("regressed", F.coalesce(F.col("change") > threshold, F.lit(False)))


def gate(metrics: DataFrame, most: dict[str, float]) -> DataFrame:
    """Metrics of one row above their bound."""
    rows = [metrics.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("bound")) for m, v in most.items()]
    return reduce(DataFrame.unionByName, rows).where("value > bound")


def accuracy(verdicts: DataFrame) -> DataFrame:
    """Accuracy and F1 by category; the row without a category is the mean over all rows, not over categories."""
    return verdicts.rollup("category").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "A").cast("double")).alias("accuracy"), F.avg("f1").alias("f1"))


def evaluation_report(scores: DataFrame, dims: list[str], outlier: float = 2.0, failure: float = 2.5) -> DataFrame:
    """By dimension: mean, sample deviation (0 for one row), values up to the outlier bound; rows whose mean is below the failure bound."""
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in dims]) / len(dims)
    x = scores.withColumn("row_mean", mean)
    long = x.select("row_mean", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("score")) for c in dims])).alias("s")).select("row_mean", "s.*")
    return long.groupBy("dimension").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("least"), F.count_if(F.col("score") <= outlier).alias("outliers"), F.count_if(F.col("row_mean") < failure).alias("failures"))


def merged(committed: DataFrame, active: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key of two sources; the later source's values come first where they are not null."""
    a = active.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return committed.select(key, *columns).join(a, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])
