import random
import re

import pytest

from arbor.llm.components import connected_components
from arbor.llm.jaccard_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    sets = [(-(1 << 63) if i is None else i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    clean = lambda v: None if v == -(1 << 63) else v
    return sorted(((clean(d), len(s), clean(least[find(i)])) for i, (d, s) in enumerate(sets)), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    hot = [word() for _ in range(30)]
    rows = []
    for f in range(12):
        base = [word() for _ in range(r.choice([4, 20, 60, 120]))]
        for c in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(hot * (f % 3 == 0) + w)))
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, "a b"), (905, "É a b c"), (906, "é a b c"), (None, rows[0][1]), (3, rows[9][1]), (3, rows[3][1])]
    rows += [(1000 + i, "All rights reserved. " + " ".join(hot)) for i in range(20)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = jaccard_components(df, shingle=k, percent=percent, cell_bytes=4000).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows, k, percent)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(80_000)]
    near = words[:]
    near[5] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::2]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {1: (79_998, 1), 2: (79_998, 1), 3: (39_998, 3)}


def test_one_id_and_one_text_on_many_rows(spark):
    """Rows with a null id, and rows with the same text, are dealt to many cells and give the same components."""
    rows = [(None, f"text number {i} of a null id with some words") for i in range(60)] + [(i, "one text that very many rows have") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (500, 1 << 20):
        got = jaccard_components(df, cell_bytes=size).collect()
        assert len(got) == 260 and {r.component_id for r in got if r.doc_id is not None} == {0} and {r.component_id for r in got if r.doc_id is None} == {None}
