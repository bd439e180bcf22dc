"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
documents. The result of each is written as Parquet and read again as the docs of the next.

Rules, which hold for every stage. Null ids and null texts are rows like others: a null text is empty, scores the share of
good documents in the sample, has no near duplicate, no leak and no secret, and gives no tokens; where it stays, it stays
null. Rows with one id and different texts are different documents. Rows with the same id and text are near duplicates of
each other, so one stays, unless they have no words. Texts may be of any length; further columns are carried through all
stages but the last. An empty table gives an empty result, and without labels no document is
rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import bpe_tree, jaccard_join, neighbour_quality, queries, secret_scan, template_leaks
from arbor.llm.shared import ensure_checkpoint_dir, small_batches, stage_folder, table

#: Bytes of text in a cell of near_duplicates: half of what the operator takes by itself, as workers here also hold what other stages left.
CELL_BYTES = 3 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go."""
    small_batches(spark)
    model = neighbour_quality.fit(docs, table(spark, sf_dir, "labels"))
    return neighbour_quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, five-word shingles and a similarity of 0.8: of each group one row stays, that with the least id and text hash.

    Ids may be null and repeat; rows without words are in no group and stay.
    """
    ensure_checkpoint_dir(spark)
    groups = jaccard_join.jaccard_components(docs, shingle=5, percent=80, keys=True, cell_bytes=CELL_BYTES).where("component_key is not null")
    rows = groups.groupBy("component_key", "doc_id", "row_key").agg(F.count("*").alias("n")).checkpoint()
    first = rows.groupBy("component_key").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    stays = (F.col("row_key") == F.col("first.row_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    many = rows.join(first, "component_key").select("doc_id", "row_key", stays.alias("stays"), "n").where("n > 1 or not stays")
    many = many.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "stays").distinct().checkpoint()
    if many.count() <= template_leaks.BROADCAST_WINDOWS:
        many = F.broadcast(many)
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    same = (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))  # two rows of one id would have to meet by chance
    alone = keyed.join(many, same, "left_anti")
    repeated = keyed.join(many.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "__row"])
    return alone.unionByName(repeated).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark question, also with other parameters, go."""
    ensure_checkpoint_dir(spark)
    return template_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets in the texts are replaced by [SECRET]."""
    return secret_scan.redact(docs, secret_scan.default_model(spark, docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of every text."""
    small_batches(spark)
    out = bpe_tree.encode_decode(docs, queries.tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, folder = table(spark, sf_dir, "documents"), stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}_{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
