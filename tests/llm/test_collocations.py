import random
import re
from collections import Counter

import pytest

from arbor.llm.collocations import collocations


def brute(rows, max_n=3, least=10, percent=50, top=2000):
    f, n = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {}
        for q, a in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside.get(q[i : i + m], 0), a)
        got = []
        for p, a in cand.items():
            s, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * inside.get(p, 0) < percent * a:
                got.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i % 50 or None, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in cols) for r in collocations(df, **kw).collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(25)] + ["é", "É", "the", "of", " ", "日本"]
    word = lambda: vocabulary[int(r.paretovariate(0.6)) % len(vocabulary)]
    phrases = ["New York City", "new york", "machine learning model", "of the"]
    rows = []
    for _ in range(120):
        parts = [r.choice(phrases) if r.random() < 0.3 else word() for _ in range(r.randrange(60))]
        rows.append((r.choice(["en", "en", "de", None, "und"]), "".join(p + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ! "]) for p in parts)))
    return rows + [("fr", None), ("fr", ""), ("en", "..."), ("", "a b " * 20)] + [("es", "one text that is repeated")] * 30


@pytest.mark.parametrize("seed,max_n,least,cell", [(1, 3, 10, 500), (2, 3, 3, 1 << 20), (3, 4, 5, 900), (4, 2, 10, 700)])
def test_equals_brute_force(spark, seed, max_n, least, cell):
    rows = corpus(seed)
    assert run(spark, rows, max_n=max_n, min_count=least, cell_bytes=cell) == brute(rows, max_n, least)


def test_first_of_each_language_and_ties(spark):
    rows = [("en", " ".join(f"a{i} b{i} ." for i in range(40)))] * 12 + [("de", "x y . x z . " * 15)]
    assert run(spark, rows, top=7) == brute(rows, top=7)


def test_more_than_255_in_one_cell(spark):
    rows = [("en", "often said . " * 700), ("en", "often " * 400)]
    assert run(spark, rows, min_count=600) == brute(rows, least=600) and len(run(spark, rows, min_count=600)) == 1


def test_empty(spark):
    assert run(spark, []) == []


def test_very_long_texts_and_words(spark):
    rows = [("en", "very long text " * 60_000), ("en", ("q" * 200_000 + " r ") * 12)]
    assert run(spark, rows) == brute(rows)


def test_products_beyond_64_bits(spark):
    """Scores from counts whose products pass 64 bits are exact."""
    from arbor.llm.collocations import scored

    a, l, r = 9_000_000_000_007, 10_000_000_000_009, 11_000_000_000_011
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", l), ("en", "y", r)], "lang string, phrase string, n long")
    assert scored(counts).first().score == 10**6 * a * a // (l * r)
