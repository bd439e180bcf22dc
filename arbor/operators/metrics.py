"""Telemetry metrics: fidelity, pipeline and batch efficiency, phase thresholds, prices, divergences and plot data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.session import ensure_checkpoint_dir

#: Factors (k1, k2) of phase thresholds.
PHASE_FACTORS = {
    "embedding_time": (3.0, 2.0), "tiling_time": (4.0, 2.0), "scoring_time": (4.0, 2.0), "assembly_time": (4.0, 2.0),
    "search_time": (2.5, 1.5), "mmr_time": (2.5, 1.5), "coverage_map_time": (2.5, 1.5), "total_time": (3.0, 2.0),
}
#: Bounds of the regression gate; the last two are least values.
GATE_MOST = {"size_deviation": 14.0, "oversized": 9.0, "seconds_per_node": 3.0, "dollars_per_million": 1.0}
GATE_LEAST = {"pipeline_efficiency": 94.0, "fidelity": 90.0}


def positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (times), upto (rows of the key up to this value) and total: equal values are one row, and a key is no task.

    Values are dealt to ranges of (key, value); each range counts its rows, the counts of the ranges before are added.
    A key that a third of all rows have is many ranges. The ranges are written once, as bounds drawn again could differ.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = counted.repartitionByRange(int(parts), *keys, value).withColumn("__part", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("n").alias("__size"))  # a row a key and range
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumn("total", F.sum("__size").over(every)).drop("__size")
    return dealt.withColumn("upto", F.sum("n").over(w)).join(sizes, [*keys, "__part"]).withColumn("upto", F.col("upto") + F.col("__before")).drop("__part", "__before")


def values_at(ranked: DataFrame, keys: list[str], value: str, **at: Column) -> DataFrame:
    """The values at 1-based places of the ordered rows of each key; places are expressions over total."""
    pick = lambda p: F.max(F.when((F.col("upto") >= p) & (F.col("upto") - F.col("n") < p), F.col(value)))
    return ranked.groupBy(*keys).agg(*[pick(p).alias(c) for c, p in at.items()], F.max("total").alias("total"))


def linear_quantiles(ranked: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles between neighbours at place q * (n - 1) + 1."""
    at = {}
    for c, q in qs.items():
        p = F.lit(q) * (F.col("total") - 1) + 1
        at |= {f"__{c}_lo": F.floor(p), f"__{c}_hi": F.ceil(p)}
    x = values_at(ranked, keys, value, **at)
    between = lambda c, q: F.col(f"__{c}_lo") + (F.col(f"__{c}_hi") - F.col(f"__{c}_lo")) * (F.lit(q) * (F.col("total") - 1) % 1)
    return x.select(*keys, *[between(c, q).alias(c) for c, q in qs.items()])


def fidelity(nodes: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Statistics of fidelity by document, and the worst nodes of each; nodes without a value are left out."""
    x = nodes.where("fidelity is not null")
    v = F.col("fidelity")
    stats = x.groupBy("document_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("pstd"))
    w = Window.partitionBy("document_id").orderBy("fidelity", "node_id")
    return stats, x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= worst)


def pipeline_efficiency(operations: DataFrame) -> DataFrame:
    """Of (run, op, start, end): how far work ran in parallel, 0 to 100.

    Operations are counted once by op, start and end; a start of 0 is unknown. (sum - wall) / (sum - longest), 100 if
    there is nothing to run in parallel, 0 without operations.
    """
    x = operations.select("run", "op", "start", "end").where("start > 0 and end > start").dropDuplicates()
    d = F.col("end") - F.col("start")
    a = x.groupBy("run").agg(F.sum(d).alias("total"), F.max(d).alias("longest"), (F.max("end") - F.min("start")).alias("wall"))
    e = F.when(F.col("total") <= F.col("longest"), 100.0).otherwise((F.col("total") - F.col("wall")) / (F.col("total") - F.col("longest")) * 100)
    runs = operations.select("run").distinct()
    return runs.join(a, "run", "left").select("run", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), e)), F.lit(0.0)).alias("efficiency"))


def batch_efficiency(embeddings: DataFrame) -> DataFrame:
    """Of (run, batch_size, start): batches are told by size and start; how many of the embeddings shared a call."""
    n = embeddings.groupBy("run").agg(F.count("*").alias("n_embeddings"))
    b = embeddings.select("run", "batch_size", "start").dropDuplicates()
    s = F.col("batch_size")
    a = b.groupBy("run").agg(F.count("*").alias("n_batches"), F.avg(s).alias("mean_size"), F.max(s).alias("largest"), F.sum(F.greatest(F.lit(0), s - 1)).alias("batched"), F.count_if(s == 1).alias("single"))
    return a.join(n, "run").withColumn("utilisation", F.col("batched") / F.col("n_embeddings") * 100)


def batch_sizes(embeddings: DataFrame) -> DataFrame:
    """Batches by run and size."""
    return embeddings.select("run", "batch_size", "start").dropDuplicates().groupBy("run", "batch_size").agg(F.count("*").alias("n"))


def phase_statistics(timings: DataFrame) -> DataFrame:
    """(phase, median, mad, p50, p95, p99) of (phase, seconds): p by nearest place."""
    keys = ["phase"]
    ranked = positions(timings, keys, "seconds")
    med = linear_quantiles(ranked, keys, "seconds", {"median": 0.5})
    away = timings.join(F.broadcast(med), keys).withColumn("__away", F.abs(F.col("seconds") - F.col("median")))  # a row a phase
    mad = linear_quantiles(positions(away, keys, "__away"), keys, "__away", {"mad": 0.5})
    near = lambda q: F.least(F.col("total") - 1, F.floor(F.col("total") * q)) + 1
    p = values_at(ranked, keys, "seconds", p50=near(0.50), p95=near(0.95), p99=near(0.99)).drop("total")
    return med.join(mad, keys).join(p, keys)


def phase_thresholds(stats: DataFrame) -> DataFrame:
    """(phase, threshold): (k1 + k2) * MAD of the phases that have factors; without variance there is none (null)."""
    k = stats.sparkSession.createDataFrame([(p, a + b) for p, (a, b) in PHASE_FACTORS.items()], "phase string, k double")
    return stats.join(F.broadcast(k), "phase").select("phase", F.when(F.col("mad") > 0, F.col("k") * F.col("mad")).alias("threshold"))


def phase_regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Phases of both runs whose median grew by more than the baseline's threshold."""
    limits = phase_thresholds(baseline)
    x = baseline.select("phase", F.col("median").alias("was")).join(current.select("phase", F.col("median").alias("now")), "phase").join(limits, "phase")
    return x.withColumn("regressed", F.coalesce(F.col("now") - F.col("was") > F.col("threshold"), F.lit(False)))


def gate(metrics: DataFrame) -> DataFrame:
    """The bounds of GATE_MOST and GATE_LEAST that each run (a row with those columns) breaks."""
    most = [metrics.select("run", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("bound")).where("value > bound") for m, v in GATE_MOST.items()]
    least = [metrics.select("run", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("bound")).where("value < bound") for m, v in GATE_LEAST.items()]
    return reduce(DataFrame.unionByName, most + least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to -1..1; null if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def letter_vector(text: Column) -> Column:
    """A deterministic embedding for tests and plumbing: counts of the letters a to z."""
    low = F.lower(text)
    return F.array(*[F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit(""))) for c in range(97, 123)]).cast("array<double>")


def node_fidelity(parents: DataFrame, nodes: DataFrame, embed=letter_vector) -> DataFrame:
    """(id, fidelity) of (id, text, left_child_id, right_child_id): cosine of a node's text and its children's joined text under a pluggable embedding."""
    kid = lambda s: nodes.select(F.col("id").alias(f"{s}_child_id"), F.col("text").alias(f"__{s}"))
    x = parents.join(kid("left"), "left_child_id").join(kid("right"), "right_child_id")
    return x.select("id", cosine(embed(F.col("text")), embed(F.concat("__left", F.lit("\n"), "__right"))).alias("fidelity"))


def call_costs(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Adds cost in dollars, by a small table of models (model, input, output for a thousand tokens, cache_discount, write_multiplier); null for an unknown model."""
    x = usage.join(F.broadcast(models), "model", "left")
    k = lambda c: F.col(c) / 1000
    cost = k("input_tokens") * F.col("input") + k("cache_creation_tokens") * F.col("input") * F.col("write_multiplier") + k("cache_read_tokens") * F.col("input") * (1 - F.col("cache_discount")) + k("output_tokens") * F.col("output")
    return x.withColumn("cost", cost).drop("input", "output", "cache_discount", "write_multiplier")


def cost_per_million(costs: DataFrame, sources: DataFrame) -> DataFrame:
    """Dollars for a million source tokens by document."""
    total = costs.groupBy("document_id").agg(F.sum("cost").alias("cost"))
    return total.join(sources.select("document_id", "source_tokens"), "document_id").withColumn("per_million", F.when(F.col("source_tokens") > 0, F.col("cost") / F.col("source_tokens") * 1e6))


def divergences(nodes: DataFrame, told: DataFrame, target: int, most: int = 500) -> DataFrame:
    """Inner nodes farthest from a target size, the first `most` of each document, of those that telemetry tells of; with their children and the node before.

    The first are taken before telemetry is looked at, so fewer may be left.
    """
    d = F.col("token_count") - target
    w = Window.partitionBy("document_id").orderBy(F.desc(F.abs(d)), "id")
    x = nodes.where("left_child_id is not null and token_count is not null").withColumn("divergence", d).withColumn("divergence_pct", d * 100.0 / target).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    x = x.join(told.select("id"), "id", "left_semi")
    for s, how in (("left_child", "inner"), ("right_child", "inner"), ("preceding_neighbor", "left")):
        x = x.join(nodes.select(F.col("id").alias(f"{s}_id"), F.col("token_count").alias(f"{s}_tokens")), f"{s}_id", how)
    return x


def round_ratios(results: DataFrame) -> DataFrame:
    """Errors of results with a compression ratio of one decimal place against all others. Ratios are compared after rounding to nine places."""
    e = F.abs("error_pct")
    nice = F.round("ratio", 9).isin([k / 10 for k in range(1, 10)])
    return results.groupBy(F.when(nice, "round").otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.avg(e).alias("mean_abs"), F.median(e).alias("median_abs"), (F.avg((e <= 10).cast("double")) * 100).alias("within_10"), (F.avg((e <= 20).cast("double")) * 100).alias("within_20"))


def timeline(attempts: DataFrame) -> DataFrame:
    """Plot data of each node's attempts: seconds since the first known start, by height."""
    known = attempts.where("start_time > 0")
    zero = known.agg(F.min("start_time").alias("zero"))  # one row
    return known.crossJoin(F.broadcast(zero)).select("node_id", "attempt", "height", (F.col("start_time") - F.col("zero")).alias("from"), (F.col("end_time") - F.col("zero")).alias("upto"))


def level_usage(nodes: DataFrame) -> DataFrame:
    """Plot data by height: nodes, tokens, span range and mean deviation from the size a level aims at."""
    aim = F.greatest(F.lit(1.0), (F.col("span_end") - F.col("span_start")) / 4 / F.pow(F.lit(2.0), F.col("height")))
    return nodes.groupBy("height").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.avg((F.col("token_count") - aim) / aim * 100).alias("deviation"))


def consolidated(runs: DataFrame) -> DataFrame:
    """Metrics of several runs (run, metric, value) as one row a metric: runs, mean, least, most and the run of each."""
    v = F.struct("value", "run")
    return runs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")).select("metric", "n", "mean", F.col("lo.value").alias("least"), F.col("lo.run").alias("least_run"), F.col("hi.value").alias("most"), F.col("hi.run").alias("most_run"))


def backward(entries: DataFrame, cutoff: DataFrame, most: int) -> DataFrame:
    """Of each session (session, line, ts): entries newer than its cutoff from the end backwards, up to `most`; complete tells whether the cutoff was reached."""
    x = entries.join(cutoff, "session").where("ts > cutoff")
    w = Window.partitionBy("session").orderBy(F.desc("line"))
    ranked = x.withColumn("back", F.row_number().over(w))
    return ranked.withColumn("complete", F.count("*").over(Window.partitionBy("session")) <= most).where(F.col("back") <= most)
