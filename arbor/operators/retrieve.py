"""The whole retrieval path as one plan, for many requests of mixed modes on many documents.

A request has query_id, document_id, vec (null for structure only), query_text, budget, seeds, start, end, verbatim and hybrid. Its phases:

1. mode and number of seeds (R22, R08); seeds = 0 searches nothing, and all scores are 0;
2. window of leaves, snapped outwards to whole leaves (R12);
3. the verbatim tail: last leaves of the window within `verbatim` tokens, whose start is the horizon (R20);
4. the nearest leaves that overlap the window and end before the horizon (T02), and with `hybrid` their fusion with BM25 over
   all nodes of the document (R04 to R06);
5. seeds by maximal marginal relevance (R07), and the verbatim leaves with them;
6. coverage inside the window, verbatim leaves as roots of their own (R10, R13);
7. scores of candidates and their siblings (R14), means upwards, the tiling within budget + verbatim tokens, or the whole frontier
   without a budget (R18, R19);
8. the texts of the tiling (R21).

All phases are joins by request, document or coordinate; only diversity and tiling look at one request at a time, over candidates and
coverage, which seeds and tree height bound. A request with no more candidates than seeds takes them all, so it has no diversity.
Vectors are shuffled once: the join with the requests gives each candidate's score, that of its sibling, and its vector where diversity looks at it.

Rules. `request_errors` says what is wrong with a request; those requests have no tiling, and neither have requests on
documents that are not there. A null or missing start is 0, a null end the document's end, null verbatim 0, null hybrid false. A request with seeds and no
vector raises, when the path is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K
from arbor.operators import query_path as P
from arbor.operators import retrieval as R
from arbor.operators.navigation import seed_count
from arbor.operators.vector_search import BLOCK_REQUESTS, candidates_join

#: Asked documents up to which nodes of others are dropped before any shuffle.
FEW_DOCUMENTS = 10_000
#: Candidates with their vectors that one block gives out, about.
BLOCK_ROWS = 1 << 17


def document_stats(nodes: DataFrame) -> DataFrame:
    """document_id, len, last (index of the last leaf) and avg_leaf_tokens."""
    s = nodes.where("height = 0").groupBy("document_id").agg(F.max("span_end").alias("len"), F.max("level_index").alias("last"), F.sum("token_count").alias("t"), F.count("*").alias("n"))
    return s.select("document_id", "len", "last", F.floor(F.col("t") / F.col("n")).cast("long").alias("avg_leaf_tokens"))


def _windowed() -> Column:
    return (F.col("start") > 0) | (F.col("end") < F.col("len"))


def _with_defaults(requests: DataFrame, stats: DataFrame) -> DataFrame:
    x = requests.join(stats, "document_id")
    start, end = F.coalesce(F.col("start"), F.lit(0)).cast("long"), F.coalesce(F.col("end"), F.col("len")).cast("long")
    return x.withColumns({"start": start, "end": end, "verbatim": F.coalesce(F.col("verbatim"), F.lit(0)).cast("long"), "hybrid": F.coalesce(F.col("hybrid"), F.lit(False))})


def request_errors(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, error): request.empty without budget and seeds, else what is wrong with the window, or null."""
    x = _with_defaults(requests, document_stats(nodes))
    window = F.when(_windowed(), P.window_error(F.col("start"), F.col("end"), F.col("len")))
    return x.select("query_id", F.when(F.col("budget").isNull() & F.col("seeds").isNull(), "request.empty").otherwise(window).alias("error"))


def plan_requests(requests: DataFrame, nodes: DataFrame, chunk: int, multiplier: float) -> DataFrame:
    """The requests without an error, with mode, n_seeds, k (candidates) and the leaves lo to hi of their window."""
    x = _with_defaults(requests, document_stats(nodes))
    window = F.when(_windowed(), P.window_error(F.col("start"), F.col("end"), F.col("len")))
    x = x.where((F.col("budget").isNotNull() | F.col("seeds").isNotNull()) & window.isNull())
    n = F.coalesce(F.col("seeds").cast("long"), seed_count(F.col("budget"), F.col("avg_leaf_tokens")))
    x = P.leaf_window(x.withColumn("mode", P.request_mode(F.col("budget"), F.col("seeds"))).withColumn("n_seeds", n).withColumn("k", P.candidate_count(n, multiplier)), chunk)
    last = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("last")).cast("long")
    return x.withColumns({"lo": last("lo"), "hi": last("hi"), "windowed": _windowed()})


def verbatim_tail(plans: DataFrame, leaves: DataFrame) -> DataFrame:
    """(query_id, document_id, height, level_index, id, span_start) of the last leaves of each window within its verbatim tokens, with the one that crosses them.

    A leaf of a text has a token at least, so no more leaves than tokens are looked at.
    """
    asked = plans.where("verbatim > 0").select("query_id", "document_id", "verbatim", "lo", "hi")
    x = asked.join(leaves.select("document_id", "id", "height", "level_index", "span_start", "token_count"), "document_id")
    x = x.where((F.col("level_index") >= F.col("lo")) & (F.col("level_index") <= F.col("hi")) & (F.col("level_index") > F.col("hi") - F.col("verbatim") - 1))
    w = Window.partitionBy("query_id").orderBy(F.desc("level_index")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("running", F.sum("token_count").over(w)).where(F.col("running") - F.col("token_count") < F.col("verbatim"))
    return x.select("query_id", "document_id", "height", "level_index", "id", "span_start")


def candidates(plans: DataFrame, pinned: DataFrame, vectors: DataFrame, node_texts: DataFrame, chunk: int, most: int, most_text: int) -> DataFrame:
    """(query_id, document_id, leaf, id, rank, score, beside, take, vec, norm): vector candidates of each request, fused with BM25 where it is hybrid.

    vectors: document_id, leaf, id, vec, span_start, span_end and perhaps norm; node_texts: document_id, doc_key, position, text. most, most_text: the highest
    k of all requests and of hybrid ones. score and beside: products with the leaf and with its sibling; vec and norm only where diversity looks at them.

    The text search goes first: its leaves meet the vectors together with the request, so that vectors are shuffled once.
    """
    horizon = pinned.groupBy("query_id").agg(F.min("span_start").alias("horizon"))
    searching = plans.where("n_seeds > 0 and k > 0")
    inside = lambda c: F.when(F.col("windowed"), c)
    spans = [inside(F.col("lo") * chunk).alias("start"), inside(F.least(F.col("len"), (F.col("hi") + 1) * chunk)).alias("end")]
    q = searching.select("query_id", "document_id", "vec", *spans, "k", F.col("n_seeds").alias("take"), "hybrid", _crowded().alias("keep")).join(horizon, "query_id", "left")
    texts = F.lit(None).cast("array<struct<leaf:bigint,rank:int>>").alias("texts")
    if most_text:
        by_text = R.okapi(node_texts, searching.where("hybrid").select("query_id", "document_id", "query_text"), most_text)
        by_text = by_text.select("query_id", K.leaf_of(F.col("doc_key")).alias("leaf"), F.col("rank").cast("int").alias("rank")).where("leaf is not null")
        q = q.join(by_text.groupBy("query_id").agg(F.collect_list(F.struct("leaf", "rank")).alias("by_text")), "query_id", "left")
        texts = F.filter("by_text", lambda t: t["rank"] <= F.col("k")).alias("texts")
    rows = max(1, BLOCK_ROWS // most)
    met = candidates_join(q.select("*", texts), vectors.withColumnRenamed("leaf", "vec_id"), "document_id", ["document_id", "k", "take"], block_requests=min(BLOCK_REQUESTS, rows)).repartition("query_id")
    w = Window.partitionBy("query_id")
    near = met.withColumn("near", F.row_number().over(w.orderBy(F.desc_nulls_last("relevance"), "vec_id")))
    near = near.withColumn("near", F.when(F.col("relevance").isNotNull() & (F.col("near") <= F.col("k")), F.col("near")))
    # a request without vector candidates has none; the others keep their leaves of the text search
    kept = near.withColumn("any", F.max("near").over(w)).where("near is not null or (text_rank is not null and any is not null)")
    order = [F.desc(R.fused(F.col("near"), F.col("text_rank"))), F.asc_nulls_last("near"), F.asc_nulls_last("text_rank")]
    kept = kept.withColumnRenamed("vec_id", "leaf").withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return kept.select("query_id", "document_id", "leaf", K.node_id(F.col("document_id"), F.lit(0), F.col("leaf")).alias("id"), "rank", "score", "beside", "take", "vec", "norm")  # no step after the repartition moves a row, which diversity relies on


def _crowded() -> Column:
    """Requests that may have more candidates than seeds; a fusion has up to k of either ranking."""
    return F.col("k") * F.when(F.col("hybrid"), 2).otherwise(1) > F.col("n_seeds")


def diverse(found: DataFrame, lam: float) -> DataFrame:
    """The candidates with a position for the seeds: those chosen by maximal marginal relevance, or all of a request that has no more candidates than seeds."""
    x = found.withColumnRenamed("leaf", "vec_id").withColumn("relevance", F.round("score", 12))
    return R.mmr(x, None, lam, ["document_id", "id", "score", "beside"]).withColumnRenamed("vec_id", "leaf")


def seed_scores(found: DataFrame, cover: DataFrame) -> DataFrame:
    """(query_id, id, score) of the candidates in coverage and of their siblings; `query_path.seed_scores` without vectors."""
    here = cover.where("height = 0").select("query_id", "document_id", F.col("level_index").alias("leaf"), "id", "parent_id")
    own = here.join(found.select("query_id", "leaf", "score", "beside"), ["query_id", "leaf"])
    sibling = F.struct(K.node_id(F.col("document_id"), F.lit(0), K.sibling(F.col("leaf"))).alias("id"), F.when(F.col("parent_id").isNotNull(), F.col("beside")).alias("score"))
    both = own.select("query_id", F.explode(F.array(F.struct("id", "score"), sibling)).alias("x")).select("query_id", "x.*").where("score is not null")
    return both.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def retrieve(requests: DataFrame, nodes: DataFrame, vectors: DataFrame, node_texts: DataFrame, *, chunk: int, multiplier: float = 2.5, lam: float = 0.7) -> DataFrame:
    """The tilings of all requests: query_id, document_id, position, id, height, level_index, span_start, span_end, token_count, score, over_budget.

    nodes as in `sources.corpus.nodes`; vectors: document_id, leaf, id, vec, and span_start and span_end, if they are known; node_texts:
    document_id, doc_key, position, text.
    """
    about = requests.select("document_id").distinct()
    # nodes of all documents go to the joins as they are: a semi-join with many documents would shuffle them once more for each use
    held = nodes.join(F.broadcast(about), "document_id", "left_semi") if about.limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS else nodes
    plans = plan_requests(requests, held, chunk, multiplier).checkpoint()
    leaves = held.where("height = 0")
    pinned = verbatim_tail(plans, leaves).checkpoint()
    spans = vectors if {"span_start", "span_end"} <= set(vectors.columns) else vectors.join(leaves.select("id", "span_start", "span_end"), "id")
    no_vector = F.count_if((F.col("n_seeds") > 0) & (F.col("k") > 0) & F.col("vec").isNull()).alias("no_vector")
    most = plans.agg(F.max("k").alias("k"), F.max(F.when(F.col("hybrid") & (F.col("k") > 0), F.col("k"))).alias("text"), F.count_if(_crowded()).alias("crowded"), no_vector).first()  # one row
    if most.no_vector:
        raise ValueError("a request with seeds needs a vector")
    found = candidates(plans, pinned, spans, node_texts, chunk, most.k or 1, most.text or 0)
    found = (diverse(found, lam) if most.crowded else found.withColumn("position", F.col("rank").cast("long"))).select("query_id", "document_id", "leaf", "score", "beside", "position").checkpoint()
    seeds = found.where("position is not null").select("query_id", "document_id", F.lit(0).alias("height"), F.col("leaf").alias("level_index"))
    pins = pinned.select("query_id", "document_id", "height", "level_index")
    windows = plans.select("query_id", "document_id", "lo", "hi")
    cover = P.windowed_coverage(seeds.unionByName(pins).distinct(), held, windows, pins).select("query_id", *R.COVERED).checkpoint()
    scores = seed_scores(found, cover)
    still = cover.where("height = 0").join(plans.where("n_seeds = 0").select("query_id"), "query_id").select("query_id", "id", F.lit(0.0).alias("score"))
    budgets = plans.select("query_id", (F.col("budget").cast("long") + F.col("verbatim")).alias("budget"))
    return R.tile(cover, scores.unionByName(still), budgets)


def assemble(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, document_id, text): the texts (id, text) of each tiling in its order."""
    return R.assemble(tiles.join(texts.select("id", "text"), "id"))
