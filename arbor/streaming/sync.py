"""Synchronising an index with a growing log: what is done follows from the log and the index alone, so a batch may come again."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.sources import files as X

RECORDS = "session bigint, uuid bigint, ts timestamp, removed boolean"


STATE = f"{RECORDS}, batch bigint, indexed boolean"


def _settled(rows: DataFrame, dealt: str) -> DataFrame:
    """One row a record of rows (STATE, some of them `indexed`): what the log says last, and whether it is indexed now.

    The rules are those of `sync_actions`, as windows over a session: rows are shuffled once, by `dealt` (the session or its bucket).
    """
    keys = list(dict.fromkeys([dealt, "session", "uuid"]))
    last = F.max(F.struct("batch", F.coalesce("removed", F.lit(False)).alias("removed"), "ts")).alias("l")
    x = rows.repartition(dealt).groupBy(*keys).agg(last, F.max("indexed").alias("was"), F.max(F.when(F.col("indexed"), F.col("ts"))).alias("at"))
    w = Window.partitionBy(*list(dict.fromkeys([dealt, "session"])))
    x = x.withColumn("cut", F.min(F.when(F.col("was") & F.col("l.removed"), F.col("at"))).over(w))
    x = x.withColumn("keep", F.col("was") & ~F.coalesce(F.col("at") >= F.col("cut"), F.lit(False)))
    x = x.withColumn("mark", F.max(F.when(F.col("keep"), F.col("at"))).over(w))
    stays = F.col("keep") | F.col("mark").isNull() | F.coalesce(F.col("l.ts") > F.col("mark"), F.lit(False))
    known = F.col("session").isNotNull() & F.col("uuid").isNotNull()
    return x.select("session", "uuid", "l.ts", "l.removed", "l.batch", (known & stays & ~F.col("l.removed")).alias("indexed"), *[c for c in keys if c not in ("session", "uuid")])


def _run(spark: SparkSession, source: str, path: str, files: int | None, batch) -> None:
    reader = spark.readStream.schema(RECORDS)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def sync_batch(records: DataFrame, batch_id: int, path: str) -> None:
    """Takes records of a log into the index at a path; a record with `removed` takes an earlier one out of the log (a revert).

    There is no watermark: a record not later than what its session has indexed stays out, and after a revert all from its
    time on is indexed anew.
    """
    spark = records.sparkSession
    records.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
    log = spark.read.schema(f"{RECORDS}, batch bigint").parquet(f"{path}/log").where(F.col("batch") <= batch_id).withColumn("indexed", F.lit(False))
    try:
        indexed = X.read_version(spark, f"{path}/index").select("session", "uuid", "ts", F.lit(False).alias("removed"), F.lit(-1).cast("long").alias("batch"), F.lit(True).alias("indexed"))
        log = log.unionByName(indexed)
    except FileNotFoundError:
        pass
    X.write_version(_settled(log, "session").where("indexed").select("session", "uuid", "ts"), f"{path}/index")


def sync(spark: SparkSession, source: str, path: str, files: int | None = 1) -> DataFrame:
    """Takes all files that are there, so many a batch in the order of their times, and returns the index. None: all are one batch, which reads and writes the index once."""
    _run(spark, source, path, files, partial(sync_batch, path=path))
    return X.read_version(spark, f"{path}/index")


def _touched(records: DataFrame, batch_id: int, path: str, buckets: int) -> None:
    """One batch: the log and the index of the buckets of its sessions, read and written again; other buckets stay as they are."""
    spark, bucket = records.sparkSession, F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int")
    new = records.select("session", "uuid", "ts", "removed", F.lit(batch_id).cast("long").alias("batch"), F.lit(False).alias("indexed"), bucket.alias("bucket"))
    if batch_id == 0:
        new.limit(0).write.mode("append").partitionBy("bucket").parquet(f"{path}/state")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most one row a bucket
    if not touched:
        return
    old = spark.read.schema(f"{STATE}, bucket int").parquet(f"{path}/state").where(F.col("bucket").isin(touched))
    # new files are named when all are written, so the buckets may be read meanwhile
    _settled(old.unionByName(new), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/state")


def sync_by_bucket(spark: SparkSession, source: str, path: str, buckets: int = 64, files: int | None = 1) -> DataFrame:
    """As `sync`, with log and index kept by bucket of sessions: a batch reads and writes the buckets of its sessions only. A batch that comes again changes nothing."""
    _run(spark, source, path, files, partial(_touched, path=path, buckets=buckets))
    return spark.read.schema(f"{STATE}, bucket int").parquet(f"{path}/state").where("indexed").select("session", "uuid", "ts")
