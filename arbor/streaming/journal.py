"""Structured Streaming over the event journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.sources.corpus import journal


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def fold_stream(events: DataFrame) -> DataFrame:
    """Running fold of the journal by append key, for update mode: a batch emits the keys that it touches, with n as their version; the state is one row a key."""
    j = journal(events)
    return j.groupBy("append_id").agg(F.count("*").alias("n"), F.count_if(F.col("event") == "node_committed").alias("commits"), F.max("event_id").alias("last_event"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that expire after a gap; later events than the watermark are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
