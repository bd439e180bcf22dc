"""Texts, JSON lines and journals as files, and tables that change as a whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines with the path of their file; blank, broken and other lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    r = F.from_json("line", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return lines.where(F.col("line").startswith("{")).withColumn("r", r).where("r is not null and r.__bad is null").select("path", "r.*").drop("__bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (byte where the split of the file begins), line_no (order inside the split) and line.

    (path, block, line_no) is the order of lines in a file, without reading a file in one task; sorted downwards it is the reverse scan.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """path, offset (bytes before the line in its file) and line, for lines that end with one line feed.

    Bytes are summed inside the splits of a file, and the sums of the splits before are added, so no file is read in one task.
    """
    x = numbered_lines(spark, path).withColumn("n", F.octet_length("line") + 1)
    size = x.groupBy("path", "block").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumn("upto", F.sum("n").over(inside)).join(start, ["path", "block"])
    return y.select("path", (F.col("start") + F.col("upto") - F.col("n")).alias("offset"), "line")


def scan_from(spark: SparkSession, path: str, offset: int, schema: str) -> DataFrame:
    """Records of the lines that begin at a byte offset or after it, with their offsets; broken lines are left out."""
    r = F.from_json("line", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    lines = lines_with_offsets(spark, path).where(F.col("offset") >= offset).withColumn("line", F.trim("line")).where(F.col("line").startswith("{"))
    return lines.withColumn("r", r).where("r is not null and r.__bad is null").select("path", "offset", "r.*").drop("__bad")


def reset(spark: SparkSession, path: str, schema: str) -> str:
    """A new, empty version; older versions stay readable by their number."""
    return write_version(spark.createDataFrame([], schema), path)


#: What Spark says of a path that is not there, of a folder without files and of a file that is no Parquet; any other error is one.
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def load_vectors(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """The current version of a vector table (whole: the table at the path itself); empty if it is absent or broken. Other errors are raised."""
    try:
        df = spark.read.parquet(path) if whole else read_version(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    except (PySparkException, Py4JJavaError) as e:
        if not any(x in str(e) for x in _ABSENT):
            raise
        return spark.createDataFrame([], schema)
    return df


def append_journal(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_version(df: DataFrame, path: str, tries: int = 100) -> str:
    """Writes a whole new version beside the old ones and then names it as the current one; readers never see a part.

    The number is taken by creating its marker, which fails if the marker is there; so two writers never get the same one.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, at = _files(spark, f"{path}/_versions")
    fs.mkdirs(at)
    for _ in range(tries):
        n = max(_numbers(fs, at), default=0) + 1
        marker = spark._jvm.org.apache.hadoop.fs.Path(at, f"{n:012d}")
        try:
            out = fs.create(marker, False)
        except Py4JJavaError:
            continue  # another writer took the number
        out.write(bytearray(name.encode()))
        out.close()
        return name
    raise OSError(f"no number for a version of {path}")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(fs, at) -> list[int]:
    return [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()]


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """n and name of all versions."""
    fs, at = _files(spark, f"{path}/_versions")
    if not fs.exists(at) or not _numbers(fs, at):
        return None
    lines = spark.read.text(f"{path}/_versions").select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)$", 1).cast("long").alias("n"), F.col("value").alias("name"))
    return lines


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version."""
    seen = versions(spark, path)
    if seen is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{seen.orderBy(F.desc('n'), 'name').first().name}")
