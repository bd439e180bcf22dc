"""Node tables that are stored and changed: copy-on-write by document bucket.

A table is a folder of Parquet files partitioned by bucket, a hash of the document. A change reads and writes the buckets of its documents only (dynamic
partition overwrite); files of other buckets stay as they are. A bucket that loses its last row keeps one row without an id,
which `read` leaves out. Changes are given with their documents, as an id says which that is; one change at a time may write a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.operators import repository as R


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str) -> None:
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/nodes")


def create(nodes: DataFrame, path: str, buckets: int = 256) -> None:
    """Stores nodes; the number of buckets is fixed from then on."""
    nodes.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    _write(nodes.withColumn("bucket", _bucket(buckets)), path)


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/layout").first().buckets


def read(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path)[0].where("id is not null").drop("bucket")


def _change(documents: DataFrame, path: str, f: Callable[[DataFrame], DataFrame]) -> int:
    """Writes f of the buckets that hold these documents; returns how many buckets that are."""
    spark = documents.sparkSession
    stored, buckets = _stored(spark, path)
    touched = sorted(r.b for r in documents.select(_bucket(buckets).alias("b")).distinct().collect())  # at most one row a bucket
    if not touched:
        return 0
    old = stored.where(F.col("bucket").isin(touched) & F.col("id").isNotNull()).drop("bucket")
    new = f(old).withColumn("bucket", _bucket(buckets)).select(*stored.columns).checkpoint()
    left = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most one row a bucket
    empty = spark.createDataFrame([(b,) for b in touched if b not in left], "bucket int")
    _write(new.unionByName(empty, allowMissingColumns=True), path)
    return len(touched)


def upsert(changes: DataFrame, path: str) -> int:
    """Rows replace rows with their id, or are added; a node keeps its height."""
    return _change(changes, path, lambda old: R.upsert(old, changes))


def bulk_update(changes: DataFrame, path: str) -> int:
    """Sets the columns that changes has beside id and document_id, null values too; ids that are not there are left out."""
    fields = [c for c in changes.columns if c not in ("id", "document_id")]
    new = changes.select("id", F.struct(*fields).alias("__new"))

    def run(old: DataFrame) -> DataFrame:
        x = old.join(new, "id", "left")
        return x.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in fields}).select(*old.columns)

    return _change(changes, path, run)


def delete(ids: DataFrame, path: str) -> int:
    """Removes nodes by (id, document_id)."""
    return _change(ids, path, lambda old: old.join(ids.select("id"), "id", "left_anti"))


def truncate(positions: DataFrame, path: str) -> int:
    """For (document_id, position): deletes nodes that end after the position and clears links of the rest to them; other documents stay."""
    at = positions.groupBy("document_id").agg(F.min("position").alias("__at"))

    def run(old: DataFrame) -> DataFrame:
        x = old.join(at, "document_id", "left")
        kept = x.where("__at is null or span_end <= __at")
        ids = kept.select(F.col("id").alias("__id"))
        for c in ("parent_id", "following_neighbor_id"):
            there = ids.withColumnRenamed("__id", f"__{c}")
            cleared = F.when(F.col("__at").isNull() | F.col(f"__{c}").isNotNull(), F.col(c))
            kept = kept.join(there, F.col(c) == F.col(f"__{c}"), "left").withColumn(c, cleared).drop(f"__{c}")
        return kept.select(*old.columns)

    return _change(positions, path, run)
