"""The composed path against a plain program that follows its phases for one request at a time, and invariants on given tables."""

import math
import random
import re

import numpy as np
import pytest

from arbor.operators import retrieve as Q
from arbor.plans import registry as R
from arbor.session import ensure_checkpoint_dir
from arbor.sources import corpus as S

CHUNK = S.CHUNK


class Doc:
    def __init__(self, doc, text, vec):
        self.text, self.n, self.vec = text, max(1, -(-len(text) // CHUNK)), vec
        self.nodes = {}
        for h in range(self.n.bit_length()):
            for i in range(self.n >> h):
                a, b = min(len(text), (i << h) * CHUNK), min(len(text), ((i + 1) << h) * CHUNK)
                self.nodes[h, i] = (a, b, (0 if a == b else max(1, (b - a) // 4)) >> h)
        self.top = self.n.bit_length() - 1
        self.name = lambda c: f"{doc}:{c[0]}:{c[1]}"

    def parent(self, c):
        p = (c[0] + 1, c[1] >> 1)
        return p if p in self.nodes else None

    def node_text(self, c):
        a, b, t = self.nodes[c]
        return self.text[a:b] if c[0] == 0 else self.text[a : a + 4 * t]


def okapi(doc, text, k):
    words = lambda t: re.findall(r"\w+", t.lower())
    tok = {c: words(doc.node_text(c)) for c in doc.nodes}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {}
    for t in tok.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    raw = {x: math.log(n - f + 0.5) - math.log(f + 0.5) for x, f in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {x: 0.25 * mean if v < 0 else v for x, v in raw.items()}
    score = {c: sum(idf[x] * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x in words(text) if x in t) for c, t in tok.items()}
    return sorted(score, key=lambda c: (-round(score[c], 9), c))[:k]


def brute(doc, r, mult, lam=0.7):
    clip = lambda v: round(min(1.0, max(0.0, float(v))), 12)
    if r["budget"] is None and r["seeds"] is None:
        return None
    n, start, end = len(doc.text), r["start"] or 0, n if (n := len(doc.text)) is not None and r["end"] is None else r["end"]
    windowed = start > 0 or end < n
    if windowed and (start >= end or start >= n):
        return None
    avg = sum(doc.nodes[0, i][2] for i in range(doc.n)) // doc.n
    seeds = r["seeds"] if r["seeds"] is not None else max(1, r["budget"] // (avg or 100))
    k, lo, hi = int(seeds * mult), min(max(start // CHUNK, 0), doc.n - 1), min(max((end - 1) // CHUNK, 0), doc.n - 1)
    pinned, used = [], 0
    for i in range(hi, lo - 1, -1):
        if used < (r["verbatim"] or 0):
            pinned.append((0, i))
            used += doc.nodes[0, i][2]
    horizon = doc.nodes[pinned[-1]][0] if pinned else math.inf
    rel = {i: clip(doc.vec[i] @ r["vec"]) for i in range(doc.n)} if seeds else {}
    ok = lambda i: doc.nodes[0, i][1] < horizon and (not windowed or doc.nodes[0, i][0] < min(n, (hi + 1) * CHUNK) and doc.nodes[0, i][1] > lo * CHUNK)
    cand = sorted((i for i in rel if ok(i)), key=lambda i: (-rel[i], i))[:k]
    if r["hybrid"] and cand:
        by_text = okapi(doc, r["query_text"], k)
        ra, rb = {(0, i): p for p, i in enumerate(cand, 1)}, {c: p for p, c in enumerate(by_text, 1)}
        s = {c: (1 / (60 + ra[c]) if c in ra else 0.0) + (1 / (60 + rb[c]) if c in rb else 0.0) for c in {*ra, *rb}}
        cand = [c[1] for c in sorted(s, key=lambda c: (-s[c], ra.get(c, math.inf), rb.get(c, math.inf), doc.name(c))) if c[0] == 0]
    chosen, left = [], list(cand)
    while left and len(chosen) < seeds:
        value = lambda i: rel[i] if not chosen else lam * rel[i] - (1 - lam) * max(min(1.0, max(0.0, float(doc.vec[i] @ doc.vec[j]))) for j in chosen)
        i = max(left, key=value)
        chosen.append(i)
        left.remove(i)
    left_h = max(h for h in range(doc.top + 1) if lo % (1 << h) == 0 and lo + (1 << h) - 1 <= hi)
    right_h = max(h for h in range(doc.top + 1) if (hi + 1) % (1 << h) == 0 and hi + 1 - (1 << h) >= lo)
    base = {(0, i) for i in chosen} | set(pinned) | {(left_h, lo >> left_h), (right_h, hi >> right_h)}
    up = {(h, i >> (h - g)) for g, i in base for h in range(g, doc.top + 1)}
    up |= {(h, i ^ 1) for h, i in up} | {c for c in doc.nodes if doc.parent(c) is None}
    up -= {(h, i >> h) for _, i in pinned for h in range(1, doc.top + 1)}
    cover = {c for c in up if c in doc.nodes and c[1] << c[0] >= lo and ((c[1] + 1) << c[0]) - 1 <= hi}
    score = {}
    own = {(0, i) for i in cand} & cover
    asked = own | {c for c in cover if c[0] == 0 and (0, c[1] ^ 1) in own and doc.parent(c) is not None}
    for c in sorted(cover):
        kids = [score[x] for x in ((c[0] - 1, 2 * c[1]), (c[0] - 1, 2 * c[1] + 1)) if x in score and score[x] is not None] if c[0] else []
        score[c] = (sum(kids) / len(kids) if kids else 0.0) if c[0] else 0.0 if not seeds else rel[c[1]] if c in asked else None
    kids = {}
    for c in cover:
        if doc.parent(c) in cover:
            kids.setdefault(doc.parent(c), []).append(c)
    tiles, tok, val = cover - set(kids), lambda c: doc.nodes[c][2], lambda c: score[c] or 0.0
    budget = None if r["budget"] is None else r["budget"] + (r["verbatim"] or 0)

    def cost(p):
        saved, lost = sum(map(tok, kids[p])) - tok(p), sum(val(c) * tok(c) for c in sorted(kids[p])) - val(p) * tok(p)
        return (round(lost / saved, 9) if saved else math.inf, -saved, doc.name(p))

    while budget is not None and sum(map(tok, tiles)) > budget:
        open_ = [p for p in kids if all(c in tiles for c in kids[p])]
        if not open_:
            break
        p = min(open_, key=cost)
        tiles = tiles - set(kids[p]) | {p}
    return [(doc.name(c), round(score[c], 9) if score[c] is not None else None) for c in sorted(tiles, key=lambda c: (doc.nodes[c][0], doc.name(c)))]


@pytest.mark.parametrize("seed,mult", [(1, 2.5), (2, 1.0)])
def test_every_mode_equals_brute_force(spark, seed, mult):
    ensure_checkpoint_dir(spark)
    r, g = random.Random(seed), np.random.default_rng(seed)
    unit = lambda: (v := g.normal(size=8)) / np.linalg.norm(v)
    docs = {}
    for d, n in enumerate([0, 1, 399, 400, 401, 1700, 2800, 3200, 5100, 6000]):
        text = " ".join(f"w{int(r.paretovariate(0.8)) % 60}" for _ in range(n))[:n]
        docs[d] = Doc(d, text, [unit() for _ in range(max(1, -(-n // CHUNK)))])
    requests = []
    for q in range(60):
        d = r.randrange(len(docs))
        n = len(docs[d].text)
        windowed = r.random() < 0.4
        requests.append({
            "query_id": q, "document_id": d, "vec": unit(), "query_text": " ".join(f"w{r.randrange(70)}" for _ in range(6)), "budget": r.choice([None, 5, 60, 200, 400, 2000]), "seeds": r.choice([None, 0, 1, 3, 20]),
            "start": r.choice([0, n // 5, n // 2, n + 5]) if windowed else None, "end": r.choice([n, n - n // 4, n // 3]) if windowed else None, "verbatim": r.choice([None, 0, 90, 250]), "hybrid": r.choice([None, False, True]),
        })
    table = spark.createDataFrame([(d, x.text or None) for d, x in docs.items()], "doc_id long, text string")
    nodes = S.nodes(table)
    vectors = spark.createDataFrame([(d, i, f"{d}:0:{i}", v.tolist()) for d, x in docs.items() for i, v in enumerate(x.vec)], "document_id long, leaf long, id string, vec array<double>")
    from pyspark.sql import functions as F

    texts = S.with_text(nodes, table).select("document_id", F.col("id").alias("doc_key"), F.struct("height", "level_index").alias("position"), "text")
    rows = [(*(x[c].tolist() if c == "vec" else x[c] for c in requests[0]),) for x in requests] + [(99, 12345, [1.0] * 8, "no such document", 9, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id long, document_id long, vec array<double>, query_text string, budget long, seeds long, start long, end long, verbatim long, hybrid boolean")
    got = {}
    for t in Q.retrieve(df, nodes, vectors, texts, chunk=CHUNK, multiplier=mult).orderBy("query_id", "position").collect():
        got.setdefault(t.query_id, []).append((t.id, round(t.score, 9) if t.score is not None else None))
    want = {x["query_id"]: w for x in requests if (w := brute(docs[x["document_id"]], x, mult)) is not None}
    assert set(got) == set(want) and len(want) > 25
    for q in want:
        assert got[q] == want[q], (requests[q], got[q], want[q])
    bad = {x.query_id: x.error for x in Q.request_errors(df, nodes).collect()}
    assert {q for q, e in bad.items() if e} == {x["query_id"] for x in requests} - set(want)


def test_a_search_without_a_vector_raises(spark):
    ensure_checkpoint_dir(spark)
    docs = spark.createDataFrame([(1, "text " * 300)], "doc_id long, text string")
    nodes = S.nodes(docs)
    df = spark.createDataFrame([(1, 1, None, "x", 5, 2, None, None, None, None)], "query_id long, document_id long, vec array<double>, query_text string, budget long, seeds long, start long, end long, verbatim long, hybrid boolean")
    none = spark.createDataFrame([], "document_id long, leaf long, id string, vec array<double>")
    with pytest.raises(Exception, match="needs a vector"):
        Q.retrieve(df, nodes, none, S.with_text(nodes, docs).selectExpr("document_id", "id AS doc_key", "struct(height, level_index) AS position", "text"), chunk=CHUNK).collect()


def _two_requests(spark):
    """Requests for two seeds, on documents of six leaves; a vector stands for every leaf."""
    docs = spark.createDataFrame([(d, "text " * 480) for d in (1, 2)], "doc_id long, text string")
    vectors = spark.createDataFrame([(d, i, f"{d}:0:{i}", [(i + d) / 10, 1.0]) for d in (1, 2) for i in range(6)], "document_id long, leaf long, id string, vec array<double>")
    df = spark.createDataFrame([(d, d, [1.0, 0.0], None, None, 2, None, None, None, None) for d in (1, 2)], "query_id long, document_id long, vec array<double>, query_text string, budget long, seeds long, start long, end long, verbatim long, hybrid boolean")
    nodes = S.nodes(docs)
    return df, nodes, vectors, S.with_text(nodes, docs).selectExpr("document_id", "id AS doc_key", "struct(height, level_index) AS position", "text")


def test_no_diversity_where_all_candidates_are_seeds(spark, monkeypatch):
    ensure_checkpoint_dir(spark)
    parts = _two_requests(spark)
    want = sorted(Q.retrieve(*parts, chunk=CHUNK, multiplier=1.5).select("query_id", "id", "position").collect())
    assert {r.id for r in want} >= {"1:0:5", "2:0:4"}

    def never(*a, **k):
        raise AssertionError("diversity without a choice")

    monkeypatch.setattr(Q.R, "mmr", never)
    with pytest.raises(AssertionError, match="without a choice"):
        Q.retrieve(*parts, chunk=CHUNK, multiplier=1.5)
    got = sorted(Q.retrieve(*parts, chunk=CHUNK, multiplier=1.0).select("query_id", "id", "position").collect())
    assert {r.id for r in got} >= {"1:0:5", "2:0:4"} and sorted(r.position for r in got if r.query_id == 1) == list(range(len(got) // 2))


def test_coverages_are_tiled_as_a_stream(spark):
    """Coverages of several rows go over the ends of batches of two rows, and none is a group of its own for Spark."""
    cover = spark.createDataFrame(
        [(q, 7, f"7:{h}:{i}", h, i, f"7:{h + 1}:{i >> 1}" if h < 2 else None, (i << h) * 400, ((i + 1) << h) * 400, 100) for q in range(9) for h in range(3) for i in range(4 >> h)],
        "query_id long, document_id long, id string, height int, level_index long, parent_id string, span_start long, span_end long, token_count long",
    ).coalesce(1)
    scores = cover.where("height = 0").selectExpr("query_id", "id", "(query_id + level_index) / 20.0D AS score")
    budgets = cover.selectExpr("query_id", "if(query_id % 3 = 0, null, 100 * (query_id % 3 + 1)) AS budget").distinct()
    tiles = Q.R.tile(cover, scores, budgets)
    assert "GroupsInArrow" not in tiles._jdf.queryExecution().toString()
    want = sorted(tiles.collect())
    assert {q: sum(t.query_id == q for t in want) for q in range(9)} == {q: (4, 2, 3)[q % 3] for q in range(9)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(Q.R.tile(cover, scores, budgets).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_cut_for_tiles_only(spark, monkeypatch):
    """Not for all nodes, whose texts would go through a shuffle with them."""
    cut, real = [], S.with_text
    monkeypatch.setattr(S, "with_text", lambda nodes, docs: (cut.append(nodes.columns), real(nodes, docs))[1])
    text = R.QUERIES["r22_r21_text"](spark, "/root/testdata/sf0.001")
    assert "position" in cut[-1] and "over_budget" in cut[-1]
    assert text.count() > 100


def test_mixed_modes_cover_their_windows_within_budget(spark):
    """On given tables: tiles follow each other without gap or overlap; they fit the budget or say that they do not."""
    tiles = {}
    for t in R.QUERIES["r22_mixed_modes"](spark, "/root/testdata/sf0.001").orderBy("query_id", "position").collect():
        tiles.setdefault(t.query_id, []).append(t)
    n = {r.doc_id: len(r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(tiles) > 100
    for q, t in tiles.items():
        assert all(a.span_end == b.span_start for a, b in zip(t, t[1:])) and [x.position for x in t] == list(range(len(t)))
        if q % 3:
            assert t[0].span_start == 0 and t[-1].span_end == n[q]
        if q % 4 < 2 and not t[0].over_budget:
            assert sum(x.token_count for x in t) <= 200 + q % 300 + (120 if q % 4 == 1 else 0)
        if q % 4 == 3:
            assert all(x.score == 0 for x in t)


def test_vectors_meet_requests_once_and_go_no_further(spark, monkeypatch):
    """Diversity and scores take what the one join of requests and vectors gives; neither looks vectors up again."""
    ensure_checkpoint_dir(spark)
    plans, real = [], Q.R.mmr

    def mmr(candidates, *a, **k):
        plans.append(candidates._jdf.queryExecution().optimizedPlan().toString())
        return real(candidates, *a, **k)

    monkeypatch.setattr(Q.R, "mmr", mmr)
    tiles = Q.retrieve(*_two_requests(spark), chunk=CHUNK, multiplier=1.5)
    assert len(plans) == 1 and plans[0].count("FlatMapCoGroupsInArrow") == 1 and "Join" not in plans[0].split("FlatMapCoGroupsInArrow")[0]
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "vec" in line and "LogicalRDD" not in line]
    assert tiles.count() > 4


def test_vectors_may_come_with_their_norm(spark):
    from pyspark.sql import functions as F

    ensure_checkpoint_dir(spark)
    df, nodes, vectors, texts = _two_requests(spark)
    unit = vectors.withColumn("vec", Q.R.unit(F.col("vec")))
    given = vectors.withColumn("norm", Q.R.norm(F.col("vec")))
    rows = lambda v: sorted(Q.retrieve(df, nodes, v, texts, chunk=CHUNK).collect(), key=str)
    assert rows(unit) == rows(given)
