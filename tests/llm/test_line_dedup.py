import random

import pytest

from arbor.llm.line_dedup import apply_bitmaps, line_bitmaps, unpack_bitmap

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, row_key string, keep int, pos string"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=20, min_docs=3, keep="last"):
    low = lambda d: (d is not None, d)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(low(d))
    owner = {k: (max if keep == "last" else min)(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in owner or owner[key(x)] == low(d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1, "p") for d, t in rows], SCHEMA)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in apply_bitmaps(df, line_bitmaps(df, **kw)).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    lines = [f"shared line number {i} of the corpus" for i in range(12)] + ["x" * 19, "y" * 20, "é" * 19, "é" * 20, "É" * 20, "", " ", "Short"]
    rows = []
    for d in range(60):
        own = [r.choice(lines) for _ in range(r.randrange(9))] + [f"only in {d} {r.random()}"] * r.randrange(2)
        own = [r.choice(["", " ", "\t", "\r"]) + (x.upper() if r.random() < 0.3 and x.isascii() else x) + r.choice(["", "  ", "\x0b"]) for x in own]
        r.shuffle(own)
        rows.append((d, "\n".join(own)))
    rows += [(None, rows[3][1]), (None, "shared line number 1 of the corpus"), (5, rows[7][1]), (5, rows[5][1]), (61, None), (62, ""), (63, "\n\n"), (64, "y" * 20)]
    rows += [(100 + i, "a very common line that one third has\nand\na very common line that one third has") for i in range(40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 7), (3, 40)])
def test_equals_brute_force(spark, seed, partitions):
    """With many partitions the common line's run goes through several of them."""
    rows = corpus(seed)
    assert run(frame(spark, rows), partitions=partitions) == brute(rows)


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_numbers_and_first_owner(spark, min_docs):
    rows = corpus(4)
    df = frame(spark, rows)
    assert run(df, min_docs=min_docs, keep="first", min_chars=5, partitions=25) == brute(rows, 5, min_docs, "first")


def test_bitmaps(spark):
    text = "this line is in all of them\nown"
    got = {r.doc_id: r for r in line_bitmaps(frame(spark, [(i, text) for i in range(3)])).collect()}
    assert unpack_bitmap(bytes(got[0].keep), 2).tolist() == [False, True] and got[0].n_dropped == 1
    assert bytes(got[2].keep) == b"" and unpack_bitmap(b"", 2).tolist() == [True, True]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_bitmaps(df).collect() == [] and run(df) == []


def test_very_long_texts(spark):
    many = "\n".join(f"line {i % 5000} of a very long document" for i in range(60_000))
    wide = "w" * 3_000_000
    rows = [(i, many if i < 3 else wide) for i in range(6)]
    assert run(frame(spark, rows)) == brute(rows)


def test_null_ids_and_copies(spark):
    rows = [(None, f"the same line in all rows\n{i % 4}") for i in range(50)] + [(7, "the same line in all rows")] * 5
    assert run(frame(spark, rows), min_docs=2, partitions=9) == brute(rows, min_docs=2)
    assert run(frame(spark, rows), partitions=9) == brute(rows)
