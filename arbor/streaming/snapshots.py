"""Changes between successive snapshots of a catalog, as a stream."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT = "snapshot bigint, id bigint, value string"


def diff_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Writes what changed from the last snapshot seen through those of this batch, and the last one as the state of the next.

    The state of batch n is a folder of its own, so a batch that comes again reads what it read before. A snapshot comes whole in one batch; a row without an id
    tells of a snapshot that may hold no rows.
    """
    spark = rows.sparkSession
    before = spark.createDataFrame([], SNAPSHOT) if batch_id == 0 else spark.read.schema(SNAPSHOT).parquet(f"{path}/state/batch={batch_id - 1}")
    both = before.unionByName(rows).checkpoint()
    seen = sorted(r.snapshot for r in both.select("snapshot").distinct().collect())  # the snapshots of one batch
    if not seen:
        rows.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        return
    order = spark.createDataFrame([(s, i, seen[i + 1] if i + 1 < len(seen) else None) for i, s in enumerate(seen)], "snapshot bigint, i int, later bigint")
    first = 0 if before.take(1) else -1  # the number of the snapshot that was told before
    w = Window.partitionBy("id").orderBy("i")
    x = both.where("id is not null").join(F.broadcast(order), "snapshot").withColumns({"pi": F.lag("i").over(w), "pv": F.lag("value").over(w), "ni": F.lead("i").over(w)})
    follows = F.coalesce(F.col("pi") == F.col("i") - 1, F.lit(False))
    kind = F.when(F.col("i") == first, None).when(~follows, "inserted").when(~F.col("value").eqNullSafe(F.col("pv")), "changed")
    told = x.select("snapshot", "id", kind.alias("kind"), "value").where("kind is not null")
    gone = x.where(F.col("later").isNotNull() & (F.col("ni").isNull() | (F.col("ni") != F.col("i") + 1))).select(F.col("later").alias("snapshot"), "id", F.lit("removed").alias("kind"), F.lit(None).cast("string").alias("value"))
    told.unionByName(gone).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
    last = both.where(F.col("snapshot") == seen[-1])
    last.unionByName(spark.createDataFrame([(seen[-1], None, None)], SNAPSHOT)).distinct().write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")


def catalog_changes(snapshots: DataFrame, path: str) -> DataFrame:
    """(snapshot, id, kind, value): rows inserted, changed and removed from snapshot to snapshot, each told once; value is null where removed."""
    spark: SparkSession = snapshots.sparkSession
    q = snapshots.select("snapshot", "id", "value").writeStream.foreachBatch(partial(diff_batch, path=path)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("snapshot bigint, id bigint, kind string, value string, batch bigint").parquet(f"{path}/changes").drop("batch")
