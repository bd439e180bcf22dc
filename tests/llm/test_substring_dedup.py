import random
import re

from pyspark.sql import functions as F

from arbor.llm.cells import cells_for
from arbor.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: id, text, xxhash64 of the text."""
    rows = sorted(((i, t or "", k) for i, t, k in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    seen, out = set(), []
    for i, t, _ in rows:
        w = WORD.findall(t)
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "é", "b c", "Longer", "x" * 70, "y" * 64 + "z"]) + str(r.randrange(60))
    passage = [[word() for _ in range(n)] for n in (5, 19, 20, 21, 33, 80)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choice(passage) if r.random() < 0.6 else [word() for _ in range(r.randrange(40))]
        rows.append((i * 7 % 120, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, " ".join(["same"] * 90)), (504, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (None, rows[8][1]), (None, None)] + [(9, r[1]) for r in rows[:30]]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cell string")
        got = substring_dedup(df, cell_bytes=3000).collect()
        keyed = df.select("doc_id", "text", F.xxhash64("text")).collect()
        assert sorted(((g.doc_id, g.n_words, g.n_removed, g.text) for g in got), key=str) == brute(keyed, 20)
        for g in got:
            assert sum(x.end - x.start for x in g.removed) == g.n_removed


def test_small_windows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "z a b c q")], "doc_id long, text string")
    got = {g.doc_id: g.text for g in substring_dedup(df, window=3, block=2).collect()}
    assert got == {1: "a b c d", 2: "z q"}
    assert substring_dedup(df.limit(0)).collect() == []


def test_messages_grow_with_the_input():
    gb = 1e9
    assert cells_for(0) == 1 and cells_for(int(0.5 * gb)) == 80
    for size in (30 * gb, 1e3 * gb, 1e5 * gb):
        n = cells_for(int(size))
        assert n * n <= size / 1400  # one message holds 1.4 kB of text at least
        assert size / n < 400e6


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30_000:] + ["new"]))], "doc_id long, text string")
    got = {g.doc_id: (g.n_words, g.n_removed, g.text) for g in substring_dedup(df).collect()}
    assert got[1][1] == 0 and got[2] == (30_001, 30_000, "new")
