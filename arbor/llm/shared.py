"""Tables, the checkpoint folder, and memory of Python workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text that go to a Python worker at once; Spark's defaults are meant for short rows.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_held: tuple[str, dict] = ("", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the rows and bytes of text that go to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def blocks(batch: pa.RecordBatch, text: str, rows: int = 512, size: int = 512 << 10):
    """Slices of at most so many rows and, beyond one row, so many bytes of text."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, min(at + rows, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def cache(owner: str) -> dict:
    """What one operator keeps from task to task in a Python worker; another operator's is let go."""
    global _held
    if _held[0] != owner:
        _held = (owner, {})
    return _held[1]


def release(owner: str = "") -> None:
    """Gives freed memory back to the system at the end of a task, as Python workers live on; with an owner, also lets go of what another operator keeps."""
    if owner:
        cache(owner)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir as the cluster names it; a local folder only where it is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def stage_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder for the tables between stages."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
