"""Retrieval over many queries at once: vector and BM25 candidates, fusion, diversity, coverage, scores, tilings."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K
from arbor.operators.vector_search import best, matrix, products, stacked, top_k_join

WORDS = r"[\p{L}\p{N}_]+"
#: Different asked words of a document that its words are looked up in one by one.
FEW_TERMS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _positive(n: Column) -> Column:
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))


def norm(v: Column) -> Column:
    """The length of a vector; a zero vector raises."""
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), _positive), F.lit(0))


def unit(v: Column) -> Column:
    """A vector over its length, which is computed once; a zero vector raises."""
    over = lambda n: F.transform(v, lambda x: x.cast("double") / _positive(n))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), over), F.lit(0))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_bound: int = 10_000, byte_bound: int = 64 << 20) -> DataFrame:
    """(query_id, vec_id, relevance, rank): exact, relevance = dot clipped to 0..1 (to twelve places), ties by id.

    A query set below a checked number and size goes to every task: vectors are multiplied with all queries in blocks, and a block returns
    no more than k of each query. A larger one is dealt in blocks that meet blocks of vectors (`top_k_join`).
    """
    asked = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("vec").cast("long") * 8).alias("bytes")).first()
    if size.n > query_bound or (size.bytes or 0) > byte_bound:
        return top_k_join(asked, vectors, k)
    rows = asked.collect()  # at most query_bound rows and byte_bound bytes
    ids = np.array([r.query_id for r in rows], np.int64)
    q = stacked([r.vec for r in rows])

    def run(batches):
        for b in batches:
            if not len(b) or not len(ids):
                continue
            own, x = np.asarray(b.column("vec_id")), matrix(b.column("vec"))
            for first, rel in products(q, x):
                got = [best(r, own, k) for r in rel]
                at, cols = np.repeat(np.arange(len(rel)), [len(g) for g in got]), np.concatenate(got)
                yield pa.record_batch([pa.array(ids[first + at]), pa.array(own[cols], pa.int64()), pa.array(rel[at, cols])], ["query_id", "vec_id", "relevance"])

    scored = vectors.where("vec is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "query_id long, vec_id long, relevance double")
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def okapi(texts: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, document_id, doc_key, score, rank): BM25 inside each document over the texts of its nodes.

    texts: document_id, doc_key, position, text; queries: query_id, document_id, query_text, each for one document. idf is
    ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes `floor` times the mean idf of the document's terms. A term counts as often as the
    query has it. Texts without a term have score 0 and fill the k best in the order of their position.

    Texts meet the asked words of their document once and are read there once: what goes on is a row for each text, with how often it has which asked
    words, and the document frequencies, in which words that nobody asks for are counted by their frequency. A request's weights meet
    the texts of its document, so no row of a text and word is shuffled. A document that is asked for more than FEW_TERMS different words keeps all of its words.
    """
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORDS), F.lit(0))
    wanted = queries.select("document_id", F.explode_outer(toks("query_text")).alias("term")).groupBy("document_id").agg(F.collect_set("term").alias("w"))
    wanted = wanted.select("document_id", F.when(F.size("w") <= FEW_TERMS, F.col("w")).alias("wanted"))
    here = texts.join(wanted, "document_id").select("document_id", "doc_key", "position", "wanted", toks("text").alias("t"))
    asked, others = F.coalesce(F.array_intersect("t", "wanted"), F.array_distinct("t")), F.coalesce(F.array_except("t", "wanted"), F.array().cast("array<string>"))
    here = here.withColumns({"asked": asked, "others": others})
    tf = F.transform("asked", lambda term: F.struct(term.alias("term"), (F.size("t") - F.size(F.array_remove("t", term))).alias("tf")))
    here = here.select("document_id", F.struct("doc_key", "position", F.size("t").alias("dl"), tf.alias("hits")).alias("node"), "asked", "others")
    # a text gives a row of its own, with no word, and one for each of its words: asked ones, then the others
    rows = here.select("document_id", "node", "asked", F.posexplode(F.concat(F.array(F.lit("")), "asked", "others")).alias("at", "term"))
    rows = rows.select("document_id", F.when(F.col("at") == 0, F.col("node")).alias("node"), (F.col("at") <= F.size("asked")).alias("known"), "term")
    counted = rows.groupBy("document_id", "node", "known", "term").agg(F.count("*").alias("df"))
    found = counted.groupBy("document_id", "node", F.when(F.col("known"), F.col("term")).alias("term"), "df").agg(F.count("*").alias("terms")).checkpoint()
    sizes = found.where("node is not null").select("document_id", "node.*")
    stats = sizes.groupBy("document_id").agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    raw = F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = found.where("node is null").select("document_id", "term", "df", "terms").join(stats, "document_id").withColumn("raw", raw)
    idf = df.groupBy("document_id").agg((F.sum(F.col("raw") * F.col("terms")) / F.sum("terms")).alias("mean"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "raw"))).alias("idf"))
    asked = queries.select("query_id", "document_id", toks("query_text").alias("q")).join(stats.select("document_id", "avgdl"), "document_id").join(idf, "document_id", "left")
    # a term counts as often as the query has it
    weight = lambda e: (F.size("q") - F.size(F.array_remove("q", e["term"]))) * F.when(e["raw"] < 0, floor * F.col("mean")).otherwise(e["raw"])
    weights = F.transform(F.filter("idf", lambda e: F.array_contains("q", e["term"])), lambda e: F.struct(e["term"].alias("term"), weight(e).alias("weight")))
    asked = asked.select("query_id", "document_id", "avgdl", F.map_from_entries(F.coalesce(weights, F.array().cast("array<struct<term:string,weight:double>>"))).alias("weights"))
    length = lambda dl: k1 * (1 - b + b * dl / F.col("avgdl"))
    part = lambda hit: F.coalesce(F.col("weights")[hit["term"]] * hit["tf"] * (k1 + 1) / (hit["tf"] + length(F.col("dl"))), F.lit(0.0))
    score = F.aggregate("hits", F.lit(0.0), lambda acc, hit: acc + part(hit))
    every = asked.join(sizes, "document_id").select("query_id", "document_id", "doc_key", "position", score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "position")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "document_id", "doc_key", "score", "rank")


def bm25_scores(texts: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_key, score) of every text with a term of the query: Okapi BM25 over postings of the query terms only, idf = ln(1 + (N - df + .5)/(df + .5))."""
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORDS), F.lit(0))
    terms = queries.select("query_id", F.explode(F.array_distinct(toks("query_text"))).alias("term"))
    sized = texts.select("doc_key", toks("text").alias("t")).withColumn("n", F.size("t"))
    stats = sized.agg(F.count("*").alias("N"), F.avg("n").alias("avg"))
    wanted = terms.select("term").distinct()
    tf = sized.select("doc_key", "n", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_key", "n").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = stats.first()  # one row
    idf = F.log(1 + (F.lit(s.N) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(s.avg or 1.0)))
    return tf.join(df, "term").join(terms, "term").groupBy("query_id", "doc_key").agg(F.sum(part).alias("score"))


def first_k(score: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, doc_key, score) of each query with their rank, ties by doc_key."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_key")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(texts: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_key, score, rank): the k best texts of each query."""
    return first_k(bm25_scores(texts, queries, k1, b), k)


def siblings(seeds: DataFrame) -> DataFrame:
    """(query_id, id) of the seeds and of their siblings."""
    own = seeds.select("query_id", "document_id", "height", "level_index")
    both = own.unionByName(own.withColumn("level_index", K.sibling(F.col("level_index")))).distinct()
    return both.select("query_id", K.node_id(F.col("document_id"), F.col("height"), F.col("level_index")).alias("id"))


def with_siblings(seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, id, score) of the seeds and of their siblings, scored against the query too; a sibling without a term has 0."""
    known = scores.select("query_id", F.col("doc_key").alias("id"), "score")
    return siblings(seeds).join(known, ["query_id", "id"], "left").fillna({"score": 0.0})


def fused(a: Column, b: Column, k: int = 60) -> Column:
    """Score of 1-based ranks in two rankings, null where a ranking has no such row."""
    return F.coalesce(1.0 / (k + a), F.lit(0.0)) + F.coalesce(1.0 / (k + b), F.lit(0.0))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Fused order of two rankings with 1-based ranks; ties keep the first list's order, then the second's."""
    j = a.select("query_id", key, F.col("rank").alias("ra")).join(b.select("query_id", key, F.col("rank").alias("rb")), ["query_id", key], "full")
    s = fused(F.col("ra"), F.col("rb"), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), key)
    return j.withColumn("score", s).withColumn("rank", F.row_number().over(w)).select("query_id", key, "score", "rank")


def _products(a: pa.Table, b: pa.Table) -> pa.Table:
    own, other = a["vec_id"].to_numpy(), b["other_id"].to_numpy()
    sims = np.clip(stacked(a["vec"].to_pylist()) @ stacked(b["other"].to_pylist()).T, 0, 1) if len(own) and len(other) else np.zeros((len(own), len(other)))
    i, j = np.nonzero(own[:, None] != other[None, :])
    key = a["query_id"].to_numpy()[i] if len(own) else np.zeros(0, np.int64)
    return pa.table([pa.array(key, pa.int64()), pa.array(own[i], pa.int64()), pa.array(other[j], pa.int64()), pa.array(sims[i, j], pa.float64())], names=["query_id", "a", "b", "similarity"])


def similarities(left: DataFrame, right: DataFrame, block: int = 512) -> DataFrame:
    """(query_id, a, b, similarity) of all pairs of different ids within a request, from (query_id, vec_id, vec) of unit vectors; similarity = dot clipped to 0..1.

    The matrix of a request is the result, so its rows are the product of its sides; it is made in squares of about a block a side,
    so that no request is one task. Rows without a vector have no pairs.
    """
    sides = [x.where("vec is not null").select("query_id", "vec_id", F.col("vec").cast("array<double>").alias("vec")) for x in (left, right)]
    sizes = [x.groupBy("query_id").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for x, n in zip(sides, ("n_left", "n_right"))]
    squares = sizes[0].join(sizes[1], "query_id")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = sides[0].join(squares, "query_id").select("query_id", dealt("n_left").alias("i"), every("n_right").alias("j"), "vec_id", "vec")
    b = sides[1].join(squares, "query_id").select("query_id", every("n_left").alias("i"), dealt("n_right").alias("j"), "vec_id", "vec")
    # the sides may be one table, so the right one has names of its own
    b = b.toDF("query", "row", "column", "other_id", "other")
    return a.groupBy("query_id", "i", "j").cogroup(b.groupBy("query", "row", "column")).applyInArrow(_products, "query_id long, a long, b long, similarity double")


def _whole_groups(batches, key: str):
    """Tables of whole groups from batches in which the rows of a group follow each other; a group that goes on in the next batch is carried there."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([held, table]) if held is not None else table
        keys = table[key].to_numpy()
        last = int(np.flatnonzero(keys[1:] != keys[:-1])[-1]) + 1 if len(keys) and keys[0] != keys[-1] else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None and len(held):
        yield held.combine_chunks()


def mmr(candidates: DataFrame, k: int | None, lam: float = 0.7, carried: list[str] | None = None) -> DataFrame:
    """Maximal marginal relevance: (query_id, vec_id, position) from (query_id, vec_id, relevance, rank, vec), k of each query, or as many as its column `take` says.

    Sequential by nature, so one group of candidates (a few times k) is one table.

    With carried columns, all candidates come back with these, those not chosen without a position; queries with no more candidates than asked for take them all in the order of
    their rank, and need no vectors. Then the rows of a query must be in one partition, and pass as a sorted stream. Vectors may come with their norm.
    """
    columns = candidates.columns

    def chosen(rel: np.ndarray, x: np.ndarray, most: int) -> list[int]:
        sims, left, got, near = np.clip(x @ x.T, 0, 1), np.ones(len(rel), bool), [], np.zeros(len(rel))
        while len(got) < min(most, len(rel)):
            value = np.where(left, rel if not got else lam * rel - (1 - lam) * near, -np.inf)
            i = int(np.argmax(value))
            got.append(i)
            left[i] = False
            near = np.maximum(near, sims[i])
        return got

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["rank"].to_numpy(), kind="stable")
        x, rel, most = vectors(table)[order], table["relevance"].to_numpy()[order], k if k is not None else table["take"][int(order[0])].as_py()
        at = order[chosen(rel, x, most)]
        ids = [pa.array(table[c].to_numpy()[at], pa.int64()) for c in ("query_id", "vec_id")]
        return pa.table([*ids, pa.array(np.arange(1, len(at) + 1), pa.int64())], names=["query_id", "vec_id", "position"])

    def vectors(table: pa.Table) -> np.ndarray:
        x = matrix(table["vec"])
        return x / table["norm"].to_numpy()[:, None] if "norm" in columns else x

    def stream(batches):
        for table in _whole_groups(batches, "query_id"):
            keys, rel = table["query_id"].to_numpy(), table["relevance"].to_numpy()
            most = table["take"].to_numpy() if k is None else np.full(len(keys), k)
            known = ~np.asarray(table["vec"].is_null())
            x = vectors(table.filter(pa.array(known))) if known.any() else np.zeros((0, 1))
            at, position = np.cumsum(known) - 1, np.zeros(len(keys), np.int64)
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            for first, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                crowded = end - first > most[first]
                got = chosen(rel[first:end], x[at[first:end]], int(most[first])) if crowded else np.arange(end - first)
                position[first + np.asarray(got, np.int64)] = np.arange(1, len(got) + 1)
            out = table.select(["query_id", "vec_id", *carried]).append_column("position", pa.array(position, pa.int64(), mask=position == 0))
            yield from out.combine_chunks().to_batches()

    if carried is None:
        return candidates.groupBy("query_id").applyInArrow(run, "query_id long, vec_id long, position long")
    given = "".join(f", {f.name} {f.dataType.simpleString()}" for f in candidates.select(*carried).schema)
    return candidates.sortWithinPartitions("query_id", "rank").mapInArrow(stream, f"query_id long, vec_id long{given}, position long")


def coverage(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of each query's coverage: the seeds, their ancestors, the siblings of all, and the roots of the document.

    Coordinates are arithmetic, so it is one explode and one join on (document_id, height, level_index).
    """
    tops = nodes.groupBy("document_id").agg(F.max("height").alias("top"))
    s = seeds.join(tops, "document_id").select("query_id", "document_id", F.explode(F.sequence(F.col("height"), F.col("top"))).alias("h"), "height", "level_index")
    up = s.select("query_id", "document_id", F.col("h").alias("height"), K.ancestor_index(F.col("height"), F.col("level_index"), F.col("h")).alias("level_index"))
    both = up.unionByName(up.withColumn("level_index", K.sibling(F.col("level_index"))))
    asked = seeds.select("query_id", "document_id").distinct()
    roots = nodes.where("parent_id is null").select("document_id", "height", "level_index").join(asked, "document_id").select(*both.columns)
    return both.unionByName(roots).distinct().join(nodes, ["document_id", "height", "level_index"])


def _means(x: dict) -> dict[str, float | None]:
    """Scores of the nodes of one coverage by id, bottom up: leaves as given, parents the mean of their scored children, 0 if none."""
    got: dict[str, list[float]] = {}
    score: dict[str, float | None] = {}
    for k in sorted(range(len(x["id"])), key=lambda k: x["height"][k]):
        i, up = x["id"][k], x["parent_id"][k]
        score[i] = x["score"][k] if x["height"][k] == 0 else sum(got[i]) / len(got[i]) if i in got else 0.0
        if score[i] is not None and up is not None:
            got.setdefault(up, []).append(score[i])
    return score


def propagate(cover: DataFrame, leaf_scores: DataFrame) -> DataFrame:
    """(query_id, id, score) of covered nodes: leaves as given (absent: none), parents the mean of their scored children, 0 if none.

    Bottom up inside one group, the coverage of one query and document, as the tiling has it too.
    """

    def run(table: pa.Table) -> pa.Table:
        score = _means(table.to_pydict())
        ids = list(score)
        key = pa.array([table["query_id"][0].as_py()] * len(ids), pa.int64())
        return pa.table([key, pa.array(ids, pa.string()), pa.array(list(score.values()), pa.float64())], names=["query_id", "id", "score"])

    return cover.select("query_id", "document_id", "id", "parent_id", "height").join(leaf_scores, ["query_id", "id"], "left").groupBy("query_id", "document_id").applyInArrow(run, "query_id long, id string, score double")


def frontier(cover: DataFrame) -> DataFrame:
    """Covered nodes none of whose children is covered."""
    kids = cover.where("parent_id is not null").select("query_id", F.col("parent_id").alias("id")).distinct()
    return cover.join(kids, ["query_id", "id"], "left_anti")


def _roll_up(token: dict, parent: dict, score: dict, budget: float | None) -> tuple[set, int]:
    """The tiles of one coverage and their tokens: its frontier, rolled up into parents by least score mass lost for a token saved until it fits."""
    kids: dict[str, list[str]] = {}
    for i in token:
        if parent[i] in token:
            kids.setdefault(parent[i], []).append(i)
    tiles = {i for i in token if i not in kids}
    total = sum(token[i] for i in tiles)
    if budget is None or total <= budget:
        return tiles, total

    def offer(p):
        ch = kids.get(p, [])
        if ch and all(c in tiles for c in ch):
            saved = sum(token[c] for c in ch) - token[p]
            lost = sum(score[c] * token[c] for c in ch) - score[p] * token[p]
            heapq.heappush(heap, (lost / saved if saved else float("inf"), -saved, p))

    heap: list = []
    for p in kids:
        offer(p)
    while heap and total > budget:
        _, _, p = heapq.heappop(heap)
        if all(c in tiles for c in kids[p]):
            tiles -= set(kids[p])
            tiles.add(p)
            total += token[p] - sum(token[c] for c in kids[p])
            if parent[p] in token:
                offer(parent[p])
    return tiles, total


#: What the tiling reads of a coverage.
COVERED = ["document_id", "id", "parent_id", "height", "level_index", "span_start", "span_end", "token_count"]
_TILES = "query_id long, document_id long, position long, id string, height int, level_index long, span_start long, span_end long, token_count long, score double, over_budget boolean"


def greedy_tiling(scored: DataFrame, budget: int) -> DataFrame:
    """Tilings within a token budget: children are rolled up into parents by least score mass lost for a token saved.

    One group is the coverage of one query and document, of the order of seeds times tree height.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].tolist()
        score = {i: 0.0 if pd.isna(x) else x for i, x in zip(ids, pdf["score"])}
        tiles, total = _roll_up(dict(zip(ids, pdf["token_count"].tolist())), dict(zip(ids, pdf["parent_id"])), score, budget)
        out = pdf[pdf["id"].isin(tiles)].sort_values(["span_start", "id"])
        return out.assign(position=range(len(out)), over_budget=total > budget)[_TILE]

    return scored.groupBy("query_id", "document_id").applyInPandas(run, _TILES)


def _tile(x: dict[str, list]) -> dict[str, list]:
    """Scores and tiling of one coverage: see `tile`."""
    ids, n = x["id"], len(x["id"])
    score, parent = _means(x), dict(zip(ids, x["parent_id"]))
    budget = x["budget"][0]
    tiles, total = _roll_up(dict(zip(ids, x["token_count"])), parent, {i: v or 0.0 for i, v in score.items()}, budget)
    at = sorted((k for k in range(n) if ids[k] in tiles), key=lambda k: (x["span_start"][k], ids[k]))
    out = {c: [x[c][k] for k in at] for c in _TILE if c in x and c != "score"}
    return out | {"position": list(range(len(at))), "score": [score[ids[k]] for k in at], "over_budget": [budget is not None and total > budget] * len(at)}


def _tile_stream(batches):
    """Sorted coverages one after the other; one that goes on in the next batch is carried there."""
    kinds = {"id": pa.string(), "height": pa.int32(), "score": pa.float64(), "over_budget": pa.bool_()}

    def given(done):
        out = {c: [] for c in _TILE}
        for x in done:
            for c, v in _tile(x).items():
                out[c] += v
        return pa.record_batch([pa.array(out[c], kinds.get(c, pa.int64())) for c in _TILE], names=_TILE)

    held, key = None, None
    for b in batches:
        x, done = b.to_pydict(), []
        keys = list(zip(x["query_id"], x["document_id"]))
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for first, end in zip([0, *ends], [*ends, len(keys)]):
            if first == end:
                continue
            own = {c: v[first:end] for c, v in x.items()}
            if held is not None and keys[first] == key:
                for c, v in own.items():
                    held[c] += v
                continue
            if held is not None:
                done.append(held)
            held, key = own, keys[first]
        if done:
            yield given(done)
    if held is not None:
        yield given([held])


def tile(cover: DataFrame, leaf_scores: DataFrame, budgets: DataFrame) -> DataFrame:
    """What `propagate` and `greedy_tiling` give, in one pass over each coverage, with a budget for each query (query_id, budget; null: the whole frontier).

    Coverages come as a sorted stream, as most of them are a few rows, and a group of its own for each costs more than its tiling. One coverage is held at once.
    """
    x = cover.select("query_id", *COVERED)
    x = x.join(leaf_scores.select("query_id", "id", "score"), ["query_id", "id"], "left").join(budgets.select("query_id", F.col("budget").cast("long").alias("budget")), "query_id")
    return x.repartition("query_id", "document_id").sortWithinPartitions("query_id", "document_id").mapInArrow(_tile_stream, _TILES)


_TILE = ["query_id", "document_id", "position", "id", "height", "level_index", "span_start", "span_end", "token_count", "score", "over_budget"]


def assemble(tiles: DataFrame) -> DataFrame:
    """Texts of a tiling in order, empty ones skipped, joined by a blank line."""
    a = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("position", "text"))))
    return tiles.groupBy("query_id", "document_id").agg(a.alias("a")).select("query_id", "document_id", F.array_join(F.col("a.text"), "\n\n").alias("text"))


def time_to_leaf(leaves: DataFrame, times: DataFrame) -> DataFrame:
    """For each (document_id, t): the first leaf that ends at or after t, and the last that starts at or before it.

    Times and leaves in one order, once by ends downwards and once by starts upwards: a time takes the last leaf before it there,
    so no pairs are made.
    """
    asked = times.select("document_id", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("leaf"), F.lit(1).alias("asks")).distinct()
    ends = leaves.where("time_end is not null").select("document_id", F.col("time_end").alias("at"), F.col("level_index").alias("leaf"), F.lit(0).alias("asks"))
    starts = leaves.where("time_start is not null").select("document_id", F.col("time_start").alias("at"), F.col("level_index").alias("leaf"), F.lit(0).alias("asks"))
    down = Window.partitionBy("document_id").orderBy(F.desc("at"), "asks", F.desc("leaf")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("document_id").orderBy("at", "asks", "leaf").rowsBetween(Window.unboundedPreceding, 0)
    found = lambda rows, w, c: rows.unionByName(asked).withColumn(c, F.last("leaf", ignorenulls=True).over(w)).where("asks = 1").select("document_id", F.col("at").alias("t"), c)
    known = leaves.select("document_id").distinct()
    return found(ends, down, "first_leaf").join(found(starts, up, "last_leaf"), ["document_id", "t"]).join(known, "document_id", "left_semi")
