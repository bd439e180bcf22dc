"""A stored BM25 index and its pruned top-k.

The index is a folder. Texts are dealt to blocks; `postings` has, for a block and term, the numbers of the texts, the term's counts and the lengths of the
texts, and the highest count and the least length, which bound what the term adds to a score there; one row a block, with an empty term, names its
texts. `terms` has document frequencies, `stats` the number of texts, their mean length and the parameters.

A search asks some blocks first and takes the k-th score of each query found there as its threshold. In the rest, a block whose bounds
do not reach the threshold is skipped; else only texts with a term that is needed to reach it become candidates, the other terms are added
from the highest bound down, and candidates that can no longer reach it are dropped before they are scored. Nothing that could be
among the k best is dropped, so the result is that of scoring everything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"
#: Texts of a block; one task holds the asked postings of one block.
BLOCK_TEXTS = 512
#: One block of so many is asked first, for the thresholds.
FIRST_OF = 16
#: (query, term) pairs that go to every task at a time.
QUERY_TERMS = 500_000
#: Room for sums in another order, far above their error and far below the ninth place.
SLACK = 1e-7


def toks(c: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORDS), F.lit(0))


def _part(tf, n, avg, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / avg))


_POSTINGS = "block int, term string, most int, least int, df long, no array<int>, tf array<int>, n array<int>, names array<string>, words long"


def _postings(table: pa.Table) -> pa.Table:
    """The rows of one block from its texts (block, doc_key, name, words joined by blanks), numbered by doc_key."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_key", "ascending")], null_placement="at_start"))
    lists = pc.split_pattern(table["joined"].combine_chunks(), " ")
    size = np.where(pc.equal(table["joined"], "").to_numpy(), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    words = lists.flatten()
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    terms = words.dictionary.cast(pa.string())
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
    term, no = np.divmod(key, len(size))
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    df, n = np.diff(at), size[no]
    least, most = (f.reduceat(x, at[:-1]) if len(terms) else x for f, x in ((np.minimum, n), (np.maximum, tf)))
    ints = lambda x: pa.array(x, pa.int32())
    lists_of = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(ints(at), ints(x)), pa.nulls(1, pa.list_(pa.int32()))])
    last = lambda x, v: pa.concat_arrays([x, pa.array([v], x.type)])
    names = table["name"].to_pylist()
    columns = [pa.array(np.full(len(terms) + 1, table["block"][0].as_py()), pa.int32()), last(terms, ""), last(ints(most), None), last(ints(least), None), last(pa.array(df, pa.int64()), len(size)), lists_of(no), lists_of(tf), lists_of(n)]
    columns += [last(pa.nulls(len(terms), pa.list_(pa.string())), names), last(pa.nulls(len(terms), pa.int64()), int(size.sum()))]
    return pa.table(columns, names=[c.split()[0] for c in _POSTINGS.split(", ")])


def build_index(texts: DataFrame, folder: str, k1: float = 1.5, b: float = 0.75, block_texts: int = BLOCK_TEXTS) -> None:
    """Writes the index of (doc_key, text). One shuffle, of words; a block is one group, made by its task. Smaller blocks skip more and have more rows."""
    spark = texts.sparkSession
    blocks = max(1, math.ceil(texts.count() / block_texts))
    dealt = texts.select("doc_key", F.col("doc_key").cast("string").alias("name"), F.array_join(toks("text"), " ").alias("joined"), F.pmod(F.xxhash64("doc_key"), F.lit(blocks)).cast("int").alias("block"))
    dealt.groupBy("block").applyInArrow(_postings, _POSTINGS).write.mode("overwrite").parquet(f"{folder}/postings")
    written = spark.read.parquet(f"{folder}/postings")
    s = written.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("df")).alias("avg")).first()  # one row
    spark.createDataFrame([(s.n, s.avg or 1.0, blocks, k1, b, dict(texts.dtypes)["doc_key"])], "n long, avg double, blocks int, k1 double, b double, kind string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    written.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")


def weighted_terms(folder: str, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf) of the known terms of (query_id, query_text), idf = ln(1 + (N - df + .5) / (df + .5))."""
    spark = queries.sparkSession
    s = spark.read.parquet(f"{folder}/stats").first()
    terms = queries.select("query_id", F.explode(F.array_distinct(toks("query_text"))).alias("term")).distinct()
    idf = F.log(1 + (F.lit(s.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(spark.read.parquet(f"{folder}/terms"), "term").select("query_id", "term", idf.alias("idf"))


def score_pairs(folder: str, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_key, score) of given pairs (query_id, doc_key, text); pairs that share no term have no row."""
    s = queries.sparkSession.read.parquet(f"{folder}/stats").first()
    tf = pairs.select("query_id", "doc_key", toks("text").alias("t")).select("query_id", "doc_key", F.size("t").alias("n"), F.explode("t").alias("term")).groupBy("query_id", "doc_key", "n", "term").agg(F.count("*").alias("tf"))
    part = F.col("idf") * _part(F.col("tf"), F.col("n"), s.avg, s.k1, s.b)
    return tf.join(weighted_terms(folder, queries), ["query_id", "term"]).groupBy("query_id", "doc_key").agg(F.sum(part).alias("score"))


def best_of_block(lists: list[tuple], k: int, least: float) -> tuple[list[tuple[float, int]], int]:
    """The k best (score, number) of a block for one query, and how many texts were scored.

    lists: (bound, ascending numbers, what they add) of each term that the block has, all weighted; least: scores below it do not count.
    """
    lists = sorted(lists, key=lambda x: x[0])
    upto = np.cumsum([x[0] for x in lists])
    if not len(upto) or upto[-1] < least - SLACK:
        return [], 0
    needed = int(np.searchsorted(upto, least - SLACK))  # texts with lists before this one only stay below `least`
    numbers = np.concatenate([x[1] for x in lists[needed:]])
    score = np.bincount(numbers, np.concatenate([x[2] for x in lists[needed:]]), minlength=1 + max(int(x[1][-1]) for x in lists))
    stay = np.zeros(len(score), bool)
    stay[numbers] = True
    for i in reversed(range(needed)):
        stay &= score >= least - SLACK - upto[i]
        _, no, part = lists[i]
        score[no] += part  # also of texts that are out, whose scores nobody reads
    found = np.flatnonzero(stay)
    score = score[found]
    shown = np.round(score, 9)
    order = np.lexsort((found, -shown))[:k]
    return [(float(score[i]), int(found[i])) for i in order if score[i] >= least - SLACK], len(found)


def _search(asked: dict, least: dict, k: int, avg: float, k1: float, b: float):
    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        x = {c: table[c].combine_chunks() for c in table.column_names}
        at = {t: i for i, t in enumerate(x["term"].to_pylist())}
        names = x["names"][at[""]].as_py() if "" in at else []
        bound = _part(*(np.asarray(x[c].fill_null(0).to_numpy(zero_copy_only=False), np.float64) for c in ("most", "least")), avg, k1, b).tolist()
        no, tf, n = (x[c].flatten().to_numpy() for c in ("no", "tf", "n"))
        size = pc.list_value_length(x["no"]).fill_null(0).to_numpy(zero_copy_only=False)
        ends, part = np.cumsum(size), _part(tf.astype(np.float64), n, avg, k1, b)
        most, held = np.zeros(len(size)), np.flatnonzero(size)
        if len(held):
            most[held] = np.maximum.reduceat(part, (ends - size)[held])
        most, cuts = most.tolist(), list(zip((ends - size).tolist(), ends.tolist()))

        def weighted(t, idf):
            i = at[t]
            one = slice(*cuts[i])
            return idf * most[i], no[one], idf * part[one]

        for q, terms in asked.items():
            here = [(t, idf) for t, idf in terms if t in at]
            floor = least.get(q, 0.0)
            if here and sum(idf * bound[at[t]] for t, idf in here) >= floor - SLACK:
                got, n = best_of_block([weighted(t, idf) for t, idf in here], k, floor)
                rows.append((q, None, None, n))
                rows += [(q, names[no], s, 0) for s, no in got]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "doc_key", "score", "scored"])

    return run


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_key")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _found(spark: SparkSession, folder: str, terms: DataFrame, k: int) -> DataFrame:
    s = spark.read.parquet(f"{folder}/stats").first()
    asked: dict = {}
    for r in terms.collect():  # at most QUERY_TERMS or so
        asked.setdefault(r.query_id, []).append((r.term, r.idf))
    wanted = spark.createDataFrame([(t,) for t in sorted({t for x in asked.values() for t, _ in x} | {""})], "term string")
    postings = spark.read.parquet(f"{folder}/postings").join(F.broadcast(wanted), "term", "left_semi")
    schema = "query_id long, doc_key string, score double, scored long"
    run = lambda rows, least: rows.groupBy("block").applyInArrow(_search(asked, least, k, s.avg, s.k1, s.b), schema).withColumn("doc_key", F.col("doc_key").cast(s.kind))
    early = F.col("block") % FIRST_OF == 0
    first = run(postings.where(early), {}).checkpoint()
    if s.blocks == 1:
        return first
    kth = ranked(first.where("doc_key is not null"), k).where(F.col("rank") == k).select("query_id", "score").collect()  # at most one row a query
    return first.unionByName(run(postings.where(~early), {r.query_id: r.score for r in kth}))


def search(folder: str, queries: DataFrame, k: int, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(query_id, doc_key, score, scored): rows with a doc_key are candidates that hold the k best of each query; the others count the texts scored in a block."""
    spark = queries.sparkSession
    terms = weighted_terms(folder, queries.select(F.col("query_id").cast("long").alias("query_id"), "query_text"))
    parts = max(1, math.ceil(2 * terms.count() / query_terms)) if query_terms else 1
    if parts == 1:
        return _found(spark, folder, terms, k)
    out = None
    for i in range(parts):  # groups of queries, each asked in one pass over the index
        one = _found(spark, folder, terms.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k)
        out = one if out is None else out.unionByName(one)
    return out


def top_k(folder: str, queries: DataFrame, k: int, **options) -> DataFrame:
    """(query_id, doc_key, score, rank): the k best texts of each query that share a term with it, ties by doc_key."""
    return ranked(search(folder, queries, k, **options).where("doc_key is not null"), k).drop("scored")
