"""Vector search without a bound on requests, and an inverted-file index for it.

`top_k_join` meets vectors and requests that share a key (a document, a cell of the index, or one constant) in blocks of
bounded size: a key with many vectors is split by vector, one with many requests by request, and small keys share a block. A block
returns no more than k rows a request; a window merges them. Nothing goes through the driver.

The index is a folder: `centers` (cell, center) and `vectors` partitioned by cell. Centers are fitted on a bounded sample by
rounds of spherical k-means, every vector is indexed, a search reads only the cells that its requests probe, and probing all
cells is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors and requests of one block.
BLOCK_VECTORS, BLOCK_REQUESTS = 8192, 1024
#: Vectors from which centers are fitted, at most; they are chosen by a hash of their id.
SAMPLE_ROWS = 65_536
#: Bytes of centers that go to every task, at most.
CENTER_BYTES = 64 << 20
#: Vectors of a file of the index.
FILE_ROWS = 1 << 18
#: Products of requests and vectors that a task holds at once.
PRODUCTS = 1 << 20
#: Vectors of a key up to which its requests meet them as pairs, and pairs that a task holds at once.
FEW_VECTORS, PAIRS = 512, 1 << 15
#: Keys with several blocks that go to every task, at most.
MANY_BLOCKS = 10_000
#: Rows that are given out at once where a vector goes to several cells.
CELL_ROWS = 8192


def matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def stacked(rows: list) -> np.ndarray:
    """Vectors of equal length as rows of a matrix; none gives an empty one."""
    return np.array(rows, np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def best(rel: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of rel, ties to the smallest of own; those below 0 are none."""
    at = np.flatnonzero(rel >= 0)
    if len(at) > k:
        r = rel[at]
        least = np.partition(r, len(r) - k)[len(r) - k]
        above, same = at[r > least], at[r == least]
        at = np.concatenate([above, same[np.argsort(own[same], kind="stable")[: k - len(above)]]])
    return at


def products(q: np.ndarray, x: np.ndarray, most: int | None = None):
    """(number of the first request, relevance of some requests to all vectors): no more than `most` products at once, or one request."""
    step = max(1, (most or PRODUCTS) // max(1, len(x)))
    for at in range(0, len(q), step):
        rel = q[at : at + step] @ x.T
        yield at, np.round(np.clip(rel, 0, 1, out=rel), 12, out=rel)


def _by_key(keys: np.ndarray) -> dict:
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:])))


def _pairs(left: np.ndarray, right: np.ndarray):
    """(places in left, places in right) of all pairs with equal keys, for keys with few vectors; all pairs of a request in one slice."""
    order = np.argsort(right, kind="stable")
    found, first, n = np.unique(right[order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(found, left), len(found) - 1)
    rows = np.flatnonzero((found[at] == left) & (n[at] <= FEW_VECTORS))
    many = n[at[rows]]
    upto = np.cumsum(many)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        some, m = rows[begin:end], many[begin:end]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(some, m), order[np.repeat(first[at[some]], m) + step]
        begin = end


def _near(left: pa.Table, right: pa.Table, q: np.ndarray, x: np.ndarray, most: np.ndarray, windowed: bool):
    """(places of requests, places of vectors, relevance) of the nearest vectors of each request, as many as it has in `most`; a slice at a time."""
    ids, keys, own_keys = right["vec_id"].to_numpy(), left["__key"].to_numpy(), right["__key"].to_numpy()
    if windowed:
        start, end, horizon = (np.array([v if v is not None else none for v in left[c].to_pylist()], np.float64) for c, none in (("start", -np.inf), ("end", np.inf), ("horizon", np.inf)))
        lo, hi = right["span_start"].to_numpy(), right["span_end"].to_numpy()
    for i, j in _pairs(keys, own_keys):
        if windowed:
            inside = (lo[j] < end[i]) & (hi[j] > start[i]) & (hi[j] < horizon[i])
            i, j = i[inside], j[inside]
        rel = np.round(np.clip(np.einsum("ij,ij->i", q[i], x[j]), 0, 1), 12)
        order = np.lexsort((ids[j], -rel, i))
        order = order[rel[order] >= 0]
        i, j, rel = i[order], j[order], rel[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < most[i]
        yield i[first], j[first], rel[first]
    for key, at in _by_key(own_keys).items() if len(own_keys) > FEW_VECTORS else ():
        if len(at) <= FEW_VECTORS:
            continue
        rows = np.flatnonzero(keys == key)
        for first, rel in products(q[rows], x[at]):
            some = rows[first : first + len(rel)]
            if windowed:
                s, e, z = (v[some][:, None] for v in (start, end, horizon))
                rel = np.where((lo[at] < e) & (hi[at] > s) & (hi[at] < z), rel, -1.0)
            for i, r in zip(some.tolist(), rel):
                got = best(r, ids[at], int(most[i]))
                yield np.full(len(got), i), at[got], r[got]


def _meet(k: int, windowed: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "relevance": []}
        if len(left) and len(right):
            asked, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            for i, j, rel in _near(left, right, matrix(left["vec"]), matrix(right["vec"]), np.full(len(left), k), windowed):
                out["query_id"].append(asked[i])
                out["vec_id"].append(ids[j])
                out["relevance"].append(rel)
        join = lambda name, kind: pa.array(np.concatenate(out[name]) if out[name] else [], kind)
        return pa.table({"query_id": join("query_id", pa.int64()), "vec_id": join("vec_id", pa.int64()), "relevance": join("relevance", pa.float64())})

    return run


def _dots(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of pairs clipped to 0..1, added up in order as `retrieval.dot` does; nan where j is negative."""
    out = np.full(len(i), np.nan)
    at = np.flatnonzero(j >= 0)
    for k in range(0, len(at), PAIRS):
        some = at[k : k + PAIRS]
        out[some] = np.clip(np.cumsum(q[i[some]] * x[j[some]], axis=1)[:, -1], 0, 1)
    return out


def _meet_candidates(carried: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, own_keys, ids = left["__key"].to_pylist(), right["__key"].to_pylist(), right["vec_id"].to_pylist()
        i, j, rel, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), {}
        q = x = np.zeros((0, 1))
        place: dict = {}
        if len(left) and len(right):
            q, x = matrix(left["vec"]), matrix(right["vec"]) / right["norm"].to_numpy()[:, None]
            i, j, rel = (np.concatenate(v) for v in zip((i, j, rel), *_near(left, right, q, x, left["k"].to_numpy(), True)))
            place = {at: n for n, at in enumerate(zip(own_keys, ids))}
            texts = {(n, place[key, t["leaf"]]): t["rank"] for n, (key, own) in enumerate(zip(keys, left["texts"].to_pylist())) for t in own or () if (key, t["leaf"]) in place}
        ranks = [texts.pop(at, None) for at in zip(i.tolist(), j.tolist())] + list(texts.values())
        i, j = (np.concatenate([v, np.array([at[n] for at in texts], np.int64)]) for n, v in enumerate((i, j)))
        rel = np.concatenate([rel, np.full(len(texts), np.nan)])
        beside = np.array([place.get((keys[a], ids[b] ^ 1), -1) for a, b in zip(i.tolist(), j.tolist())], np.int64)
        known = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
        own = left.select(["query_id", *carried]).take(pa.array(i))
        kept = pa.array(j, mask=~left["keep"].to_numpy(zero_copy_only=False)[i].astype(bool)) if len(i) else pa.array([], pa.int64())
        more = {"vec_id": right["vec_id"].take(pa.array(j)), "relevance": known(rel), "score": known(_dots(q, x, i, j)), "beside": known(_dots(q, x, i, beside)), "text_rank": pa.array(ranks, pa.int32()), "vec": right["vec"].take(kept), "norm": right["norm"].take(kept)}
        return pa.table({**{c: own[c] for c in own.column_names}, **more})

    return run


def _in_blocks(q: DataFrame, v: DataFrame, block_vectors: int, block_requests: int):
    """Requests and vectors with a __key, each grouped by blocks, for a cogroup. A vector and its sibling (the id with its last bit turned) share a block."""
    count = lambda df, to: df.where("__key is not null").groupBy("__key").agg(F.count("*").alias(to))
    sizes = count(v, "nv").join(count(q, "nq"), "__key")
    # small keys share a block: packs by the vectors and requests that fill one, not by keys
    several = F.count_if((F.col("nv") > block_vectors) | (F.col("nq") > block_requests)).alias("n_split")
    s = sizes.agg(F.sum("nv").alias("v"), F.sum("nq").alias("q"), F.count("*").alias("n_keys"), several).first()  # one row
    packs = max(1, math.ceil(2 * max((s.v or 0) / block_vectors, (s.q or 0) / block_requests)))
    # by keys, when they are few, vectors that nobody asks are dropped before the shuffle; of many keys, only those of several blocks are looked up
    sizes = sizes.withColumns({"nv": F.ceil(F.col("nv") / block_vectors).cast("int"), "nq": F.ceil(F.col("nq") / block_requests).cast("int")})
    split = sizes if s.n_keys <= MANY_BLOCKS else sizes.where("nv > 1 or nq > 1")
    if s.n_keys <= MANY_BLOCKS or s.n_split <= MANY_BLOCKS:
        split = F.broadcast(split)
    how = "inner" if s.n_keys <= MANY_BLOCKS else "left"
    blocks = lambda df: df.join(split, "__key", how).fillna(1, ["nv", "nq"]) if how == "inner" or s.n_split else df.withColumns({"nv": F.lit(1), "nq": F.lit(1)})
    pack = F.pmod(F.xxhash64("__key"), F.lit(packs)).cast("int").alias("pack")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q, v = (x.where("__key is not null") for x in (q, v))
    q = blocks(q).withColumn("vb", many("nv")).select(*q.columns, pack, F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qb"), "vb")
    v = blocks(v).withColumn("qb", many("nq")).select(*v.columns, pack, "qb", F.pmod(F.xxhash64(F.shiftright("vec_id", 1)), F.col("nv")).cast("int").alias("vb"))
    at = ["pack", "qb", "vb"]
    return q.groupBy(*at), v.groupBy(*at)


def top_k_join(requests: DataFrame, vectors: DataFrame, k: int, key: str | None = None, block_vectors: int = BLOCK_VECTORS, block_requests: int = BLOCK_REQUESTS) -> DataFrame:
    """(query_id, vec_id, relevance, rank): the k nearest vectors of each request among those with its key, exact; ties by id.

    requests: query_id, vec, the key, and where they are windowed start, end and horizon (null: none); vectors: vec_id, vec, the key, and then span_start and
    span_end. A vector is in a window that it overlaps, and must end before the horizon. Null vectors meet nothing. A request may stand in several keys.
    """
    windowed = "horizon" in requests.columns
    name = [F.col(key) if key else F.lit(0)][0].cast("long").alias("__key")
    q = requests.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), name, *(["start", "end", "horizon"] if windowed else []))
    v = vectors.where("vec is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"), name, *(["span_start", "span_end"] if windowed else []))
    left, right = _in_blocks(q, v, block_vectors, block_requests)
    met = left.cogroup(right).applyInArrow(_meet(k, windowed), "query_id long, vec_id long, relevance double")
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates_join(requests: DataFrame, vectors: DataFrame, key: str, carried: list[str], block_vectors: int = BLOCK_VECTORS, block_requests: int = BLOCK_REQUESTS) -> DataFrame:
    """What later steps ask of the vectors of each request's candidates, so that vectors are shuffled once.

    requests: query_id, vec, the key, start, end and horizon as in `top_k_join`, k (of this request), texts (its candidates of another search, an array of leaf and
    rank, or null), keep (whether it needs its candidates' vectors) and carried columns, k among them; vectors: vec_id, vec, the key, span_start, span_end and, where vec
    is not of unit length, its norm.

    A row (query_id, carried columns, vec_id, relevance, score, beside, text_rank, vec, norm) is a vector that is among the k nearest of a block, or one of texts
    (text_rank; relevance is null where it is not among the nearest). score and beside are the products with it and with its sibling, not rounded; beside is
    null without one.
    """
    name = F.col(key).cast("long").alias("__key")
    norm = F.col("norm") if "norm" in vectors.columns else F.lit(1.0)
    q = requests.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), name, "start", "end", "horizon", "texts", "keep", *carried)
    v = vectors.where("vec is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vec", norm.alias("norm"), name, "span_start", "span_end")
    left, right = _in_blocks(q, v, block_vectors, block_requests)
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.select("query_id", *carried).schema)
    schema = f"{given}, vec_id long, relevance double, score double, beside double, text_rank int, vec {v.schema['vec'].dataType.simpleString()}, norm double"
    return left.cogroup(right).applyInArrow(_meet_candidates(carried), schema)


def _nearest(x: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """The nearest centers of each vector, ties to the smallest number."""
    out, step = np.zeros((len(x), min(probes, len(centers))), np.int64), max(1, PRODUCTS // max(1, len(centers)))
    for at in range(0, len(x), step):
        near = np.round(x[at : at + step] @ centers.T, 12)
        out[at : at + step] = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
    return out


def _checked(centers: np.ndarray) -> np.ndarray:
    if centers.nbytes > CENTER_BYTES:
        raise ValueError(f"{centers.nbytes} bytes of centers go to every task: take fewer cells")
    return centers


def with_cells(vectors: DataFrame, centers: np.ndarray, probes: int = 1) -> DataFrame:
    """The rows with a vector, one for each of their `probes` nearest cells, the nearest with near = 0."""
    centers = _checked(centers)

    step = max(1, CELL_ROWS // max(1, probes))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                near = _nearest(matrix(b.column("vec")), centers, probes)
                out = b.take(pa.array(np.repeat(np.arange(len(b)), near.shape[1])))
                yield pa.record_batch([*out.columns, pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(b)))], [*b.schema.names, "cell", "near"])

    some = vectors.where("vec is not null").withColumn("vec", F.col("vec").cast("array<double>"))
    return some.mapInArrow(run, T.StructType([*some.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.IntegerType())]))


def _partial(centers: np.ndarray):
    def run(batches):
        n, total = np.zeros(len(centers), np.int64), np.zeros_like(centers)
        for b in batches:
            if len(b):
                x = matrix(b.column("vec"))
                cell = _nearest(x, centers, 1)[:, 0]
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["cell", "total"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"cell": table["cell"][:1].cast(pa.int32()), "total": pa.array([matrix(table["total"]).sum(axis=0).tolist()], pa.list_(pa.float64()))})


def fit_centers(vectors: DataFrame, cells: int, rounds: int = 6, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit centers of at most so many cells, from at most about sample_rows vectors; the sums of a round come back as one row a cell."""
    some = vectors.where("vec is not null").select(F.xxhash64("vec_id").alias("h"), "vec_id", F.col("vec").cast("array<double>").alias("vec"))
    n = some.count()
    if n > sample_rows:
        some = some.where(F.pmod("h", F.lit(1 << 20)) < math.ceil(sample_rows / n * (1 << 20)))
    some = some.checkpoint()
    first = some.orderBy("h", "vec_id").limit(cells).select("vec").collect()  # at most `cells` rows
    centers = np.unique(stacked([r.vec for r in first]), axis=0) if first else stacked([])
    for _ in range(rounds if len(centers) else 0):
        sums = some.mapInArrow(_partial(_checked(centers)), "cell int, total array<double>").groupBy("cell").applyInArrow(_summed, "cell int, total array<double>")
        for r in sums.collect():  # at most one row a cell
            length = np.linalg.norm(r.total)
            if length > 0:
                centers[r.cell] = np.array(r.total) / length
    return centers


def _centers(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/centers").orderBy("cell").collect()  # at most CENTER_BYTES
    return stacked([r.center for r in rows])


def _write(placed: DataFrame, folder: str, mode: str) -> None:
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    dealt = placed.join(F.broadcast(counts), "cell").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))  # counts: one row a cell
    dealt.repartition("cell", "file").drop("files", "file").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{folder}/vectors")


def build_index(vectors: DataFrame, folder: str, cells: int | None = None, **fit) -> int:
    """Fits centers, indexes every vector, and returns the number of cells; by default the square root of the number of vectors."""
    spark = vectors.sparkSession
    cells = cells or max(1, math.isqrt(vectors.where("vec is not null").count()))
    centers = fit_centers(vectors, cells, **fit)
    spark.createDataFrame([(i, c) for i, c in enumerate(centers.tolist())], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centers")
    if len(centers):
        _write(with_cells(vectors, centers).drop("near"), folder, "overwrite")
    return len(centers)


def append(vectors: DataFrame, folder: str) -> None:
    """Indexes new vectors; only the folders of their cells get new files. The centers stay."""
    _write(with_cells(vectors, _centers(vectors.sparkSession, folder)).drop("near"), folder, "append")


def upsert(vectors: DataFrame, folder: str) -> None:
    """Replaces vectors by id, or adds them; only cells that hold an old or a new version are written again."""
    spark = vectors.sparkSession
    new = with_cells(vectors, _centers(spark, folder)).drop("near").checkpoint()
    old = spark.read.parquet(f"{folder}/vectors")
    ids = new.select("vec_id").distinct()
    touched = [r.cell for r in new.select("cell").unionByName(old.join(ids, "vec_id", "left_semi").select("cell")).distinct().collect()]  # at most one row a cell
    stay = old.where(F.col("cell").isin(touched)).join(ids, "vec_id", "left_anti").select(*new.columns)
    rows = stay.unionByName(new).checkpoint()
    left = {r.cell for r in rows.select("cell").distinct().collect()}  # at most one row a cell
    # a cell all of whose vectors went elsewhere is written with one row without a vector, which no search meets
    empty = spark.createDataFrame([(c,) for c in touched if c not in left], "cell int")
    _write(rows.unionByName(empty, allowMissingColumns=True), folder, "overwrite")


def probes_for(spark: SparkSession, folder: str, k: int, recall: float, sample: int = 256) -> int:
    """The fewest probes with which a sample of the indexed vectors finds this share of its k nearest others, held against the exact search."""
    centers, all_vectors = _centers(spark, folder), spark.read.parquet(f"{folder}/vectors").where("vec is not null")
    asked = all_vectors.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), "vec").checkpoint()
    nearest = top_k_join(asked, all_vectors, k + 1).where("query_id <> vec_id").where(F.col("rank") <= k + 1).select("query_id", "vec_id")
    cells = with_cells(asked, centers, len(centers)).select("query_id", "cell", "near")
    at = nearest.join(all_vectors.select("vec_id", "cell"), "vec_id").join(cells, ["query_id", "cell"]).groupBy("near").agg(F.count("*").alias("n")).collect()  # at most one row a cell
    total, seen = sum(r.n for r in at), 0
    for r in sorted(at, key=lambda r: r.near):
        seen += r.n
        if seen >= recall * total:
            return r.near + 1
    return max(1, len(centers))


def search_index(requests: DataFrame, folder: str, k: int, probes: int | None) -> DataFrame:
    """(query_id, vec_id, relevance, rank) among the vectors of the `probes` nearest cells of each request; None: all cells, which is exact."""
    spark = requests.sparkSession
    centers = _centers(spark, folder)
    if not len(centers):
        return spark.createDataFrame([], "query_id long, vec_id long, relevance double, rank int")
    asked = with_cells(requests.select("query_id", "vec"), centers, min(probes or len(centers), len(centers))).drop("near").checkpoint()
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most one row a cell
    kept = spark.read.parquet(f"{folder}/vectors").where(F.col("cell").isin(cells))  # read from the folders of these cells only
    return top_k_join(asked, kept, k, "cell")
