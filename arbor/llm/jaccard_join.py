"""N-gram Jaccard join with grouped prefixes, exact for any percentage, and its components.

1. The number of documents that hold each shingle is counted corpus-wide (cells and buckets); a document's
   shingles are ordered by the binary logarithm of that number, rarest first, and then by hash.
   A shingle that one document alone holds can be in no intersection, which bounds what two sets share.
2. The first n - ceil(t n) + 1 shingles are its prefix: two documents that link share one of them. Shingles
   of one document only are never sent.
3. Documents with equal sets become one class; classes with the same prefix and size become one group.
4. Groups that share a prefix shingle and fit in size are candidate pairs; pairs are expanded to members and
   verified on the whole sets. First each posting is compared with its hub, the group with the fewest
   shingles of its own; then every pair of members that is still in two components. Pairs inside a component
   are not expanded, which loses no component.

Rules. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document with fewer words than the shingle
length has one shingle, all its words; one without words, or null, links with nothing. Null ids are one id
below all others. Rows with the same id but other text are separate texts. Extra columns are ignored. An
empty table gives an empty result. Sets are 64-bit hashes; equal sets are told by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm import cells as C
from arbor.llm.components import connected_components
from arbor.llm.shared import release
from arbor.llm.textnum import bucket_of, mix, utf8, windows, word_hashes

_U = np.uint64
#: Pairs up to which the ids of their classes (two short strings a pair) are broadcast; beyond, Spark shuffles.
BROADCAST_PAIRS = 100_000
_SENT = "bucket int, cell int, data binary"
_ANSWER = "cell int, bucket int, kind int, data binary"
_DOC = "doc_id long, n long, node string, grp string, rare long, tokens array<long>, shingles binary"


def _sets(table: pa.Table, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sorted distinct shingle hashes of the documents."""
    h, first = word_hashes(*utf8(table["text"]), lower=True)
    w, ok = windows(h, first, k)
    upto = np.concatenate([[0], np.cumsum(ok)])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k or a == b:
            sets.append(np.unique(w[upto[a] : upto[b]]))
        else:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix(one * _U(0x9E3779B97F4A7C15) + x)
            sets.append(one)
    return C.ids_of(table["doc_id"]), sets


def _ask(n: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        release("jaccard_join")
        cell = table["cell"][0].as_py()
        _, sets = _sets(table, k)
        have, times = np.unique(np.concatenate(sets), return_counts=True)
        low, times, bounds = (have & _U(0xFFFFFFFF)).astype(np.uint32), np.minimum(times, 255).astype(np.uint8), bucket_of(have, n)
        rows = [(b, times[x:y].tobytes() + low[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "cell": pa.array([cell] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For every hash sent: 0 if one document has it, else one more than the binary logarithm of the number."""
    cells, data = table["cell"].to_pylist(), table["data"].to_pylist()
    sizes = [len(d) // 5 for d in data]
    times = np.concatenate([np.frombuffer(d, np.uint8, n) for d, n in zip(data, sizes)])
    low = np.concatenate([np.frombuffer(d[n:], np.uint32) for d, n in zip(data, sizes)])
    _, where = np.unique(low, return_inverse=True)
    total = np.bincount(where, times)[where]
    level = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
    b = table["bucket"][0].as_py()
    return pa.table({"cell": pa.array(cells, pa.int32()), "bucket": pa.array([b] * len(cells), pa.int32()), "kind": pa.array([0] * len(cells), pa.int32()), "data": pa.array([x.tobytes() for x in np.split(level, np.cumsum(sizes)[:-1])], pa.binary())})


def _key(h: np.ndarray, n: int) -> str:
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(h, dtype=np.uint64), np.bitwise_xor.reduce(mix(h * _U(0xD6E8FEB86659FD93) + _U(n)))
    return f"{int(a):016x}{int(b):016x}{n:x}"


def _prefixes(n: int, k: int, percent: int, keys: bool = False):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        release("jaccard_join")
        out = {x.split()[0]: [] for x in _DOC.split(", ")}
        if len(table):
            ids, sets = _sets(table, k)
            have = np.unique(np.concatenate(sets))
            level = C.spread(C.unpack(answers, 0, n, np.uint8), bucket_of(have, n))
            for i, s in zip(ids.tolist(), sets):
                m, row = len(s), (None, None, None, None, None)
                if m:
                    own = level[np.searchsorted(have, s)]
                    order = np.lexsort((mix(s), own))[: m - (percent * m + 99) // 100 + 1]
                    prefix = s[order]
                    tokens = prefix[own[order] > 0]
                    if len(tokens):
                        row = (_key(s, m), _key(prefix, m), int((own == 0).sum()), tokens.astype(np.int64).tolist(), s.tobytes())
                for name, v in zip(out, (i, m, *row)):
                    out[name].append(v)
        key = {"row_key": table["row_key"].combine_chunks().cast(pa.int64())} if keys else {}
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "node": pa.array(out["node"], pa.string()), "grp": pa.array(out["grp"], pa.string()), "rare": pa.array(out["rare"], pa.int64()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64())), "shingles": pa.array(out["shingles"], pa.binary())} | key)

    return run


def _verifier(percent: int):
    def run(batches):
        for t in batches:
            x, y = t.column("sa").to_pylist(), t.column("sb").to_pylist()
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, classes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. Only the sets of classes in pairs move, each read from one document of its class."""
    pairs = pairs.checkpoint()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", F.col("least_id").alias("doc_id")), "node")
    if pairs.count() <= BROADCAST_PAIRS:
        needed = F.broadcast(needed)
    sets = held.select("node", "doc_id", "shingles").join(needed, ["node", "doc_id"]).groupBy("node").agg(F.first("shingles").alias("shingles"))
    whole = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return whole.select("a", "b", "sa", "sb").mapInArrow(_verifier(percent), "a string, b string")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, cell_bytes: int = C.CELL_BYTES, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and class_key (equal for equal sets; null if nothing can link).

    With keys, also row_key (xxhash64 of id and text) and component_key, which tells components with the same least id apart.
    """
    key = [F.xxhash64(id_col, text_col).alias("row_key")] if keys else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *key)
    n = C.n_cells(docs, "text", cell_bytes)
    dealt = docs.withColumn("cell", C.cell_of(n, "doc_id", "text"))
    levels = dealt.groupBy("cell").applyInArrow(_ask(n, shingle), _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    rows = dealt.groupBy("cell").cogroup(levels.groupBy("cell")).applyInArrow(_prefixes(n, shingle, percent, keys), _DOC + (", row_key long" if keys else "")).checkpoint()
    held = rows.where("node is not null")
    classes = held.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", "grp", "rare", "tokens")]).checkpoint()

    def fits(a: str, b: str):
        """What two sets may share at most, given their sizes and the shingles no other document has, reaches the percentage."""
        most = F.least(F.col(f"{a}.n") - F.col(f"{a}.rare"), F.col(f"{b}.n") - F.col(f"{b}.rare"))
        return most * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - most) * percent

    groups = classes.groupBy("grp").agg(F.first("tokens").alias("tokens"), F.min(F.struct("rare", "n", "node")).alias("hub"))
    posted = groups.select("grp", "hub", F.explode("tokens").alias("token"))
    hubs = posted.groupBy("token").agg(F.min("hub").alias("top"), F.count("*").alias("m")).where("m > 1").select("token", "top")
    members = classes.select("grp", "node")
    to_hub = posted.join(hubs, "token").where(fits("hub", "top")).select("grp", F.col("top.node").alias("b")).unionByName(groups.select("grp", F.col("hub.node").alias("b"))).distinct()
    first = members.join(to_hub, "grp").where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    edges = _verify(first, classes, held, percent).checkpoint()
    stars = connected_components(edges)

    placed = members.join(stars, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp")).checkpoint()
    spans = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    left = posted.join(groups.select("grp", "tokens"), "grp").join(spans, "grp")
    open_tokens = left.groupBy("token").agg(F.min("lo").alias("tl"), F.max("hi").alias("th")).where("tl <> th").select("token")
    left = left.join(open_tokens, "token", "left_semi")
    x, y = (left.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("grp", "lo", "hi", "hub", "tokens")]) for i in (1, 2))
    apart = ~((F.col("lo1") == F.col("hi1")) & (F.col("lo1") == F.col("lo2")) & (F.col("lo2") == F.col("hi2")))
    # what follows a prefix adds at most ceil(t n) - 1 to the shingles that both prefixes hold; a pair counts at the first of them
    both, after = F.array_intersect("tokens1", "tokens2"), F.floor((F.greatest("hub1.n", "hub2.n") * percent + 99) / 100) - 1
    enough = (F.size(both) + after) * (100 + percent) >= (F.col("hub1.n") + F.col("hub2.n")) * percent
    pairs = x.join(y, "token").where((F.col("grp1") < F.col("grp2")) & fits("hub1", "hub2") & apart & enough & (F.element_at(both, 1) == F.col("token"))).select("grp1", "grp2").unionByName(spans.where("lo <> hi").select(F.col("grp").alias("grp1"), F.col("grp").alias("grp2"))).distinct()
    m1, m2 = (placed.select(F.col("grp").alias(f"grp{i}"), F.col("node").alias(f"node{i}"), F.col("comp").alias(f"comp{i}")) for i in (1, 2))
    rest = pairs.join(m1, "grp1").join(m2, "grp2").where("comp1 <> comp2").select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verify(rest, classes, held, percent)
    final = connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    reach = classes.select("node", "least_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reach.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = reach.select("node", "component").join(least, "component").select("node", "component_id", *(["component"] if keys else []))
    out = rows.select("doc_id", "n", "node", *(["row_key"] if keys else [])).join(of_class, "node", "left")
    back = lambda c: F.when(c != C.NULL_ID, c)
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component_id", "doc_id")).alias("component_id"), F.col("node").alias("class_key"), *(["row_key", F.col("component").alias("component_key")] if keys else []))
