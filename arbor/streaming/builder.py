"""Incremental building: units arrive as files, each batch adds its leaves and the nodes that they complete."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from arbor.operators import build as B

UNITS = "document_id bigint, unit_no bigint, n_chars bigint, time_start double, time_end double"
NODES = "document_id bigint, height int, level_index bigint, span_start bigint, span_end bigint, token_count bigint, time_start double, time_end double, batch bigint"


def nodes_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def add_batch(units: DataFrame, batch_id: int, path: str) -> None:
    """Adds a batch to the tree at a path. A batch that comes again replaces what it wrote, so a restart changes nothing.

    Of the stored tree only leaves of the batch's documents are read.
    """
    spark = units.sparkSession
    spark.createDataFrame([], NODES).drop("batch").write.mode("ignore").parquet(f"{path}/batch=-1")
    asked = units.select("document_id").distinct()
    stored = nodes_at(spark, path).where(f"height = 0 and batch <> {batch_id}").join(asked, "document_id", "left_semi").drop("batch", "height")
    fresh = B.append(stored, units).persist()
    above = B.new_parents(fresh, stored.unionByName(fresh))
    out = fresh.selectExpr("document_id", "cast(0 as int) as height", "level_index", "span_start", "span_end", "token_count", "time_start", "time_end")
    out.unionByName(above.selectExpr("document_id", "cast(height as int) as height", *out.columns[2:])).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    fresh.unpersist()


def build(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Takes all files that are there, one a batch in the order of their times, and returns the nodes."""
    stream = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 1).json(source)
    q = stream.writeStream.foreachBatch(partial(add_batch, path=f"{path}/nodes")).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return nodes_at(spark, f"{path}/nodes")
