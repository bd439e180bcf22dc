import re

from arbor.llm.template_leaks import UNITS, drop_leaks, leaks

ITEMS = [
    (1, "Alice buys 12 apples and gives 5 kg of them to Bob before Alice walks home with 12 pears"),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds watch from above"),
    (3, "too short"), (4, None), (5, "12 13 14 15 16 17 18 19 20"),
]
DOCS = [
    (10, "Some text. " + ITEMS[0][1] + ". More text follows here."),
    (11, "noise before Carol buys 31 apples and gives 7 kg of them to Dave before Carol walks home with 31 pears and after"),
    (12, "noise Carol buys 31 apples and gives 7 kg of them to Dave before Erin walks home with 99 pears"),
    (13, "THE quick, brown fox\njumps over the lazy dog; while seven small birds"),
    (14, "the quick brown fox sleeps"), (15, None), (16, ""), (17, "1 2 3 4 5 6 7 8 9"), (None, ITEMS[1][1]), (10, ITEMS[1][1]),
]


def canon(text):
    raw = re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", text or "")
    out = []
    for i, t in enumerate(raw):
        if t[0].isdigit():
            out.append("<n>")
        elif t.lower() in UNITS and i and raw[i - 1][0].isdigit():
            out.append("<u>")
        elif len(t) > 1 and t[0].isupper() and t[1:].islower():
            out.append("<p>")
        else:
            out.append(t.lower())
    return raw, out


def brute(docs, items, w=6, need=0.5):
    got = []
    for d, dt in docs:
        draw, dc = canon(dt)
        dw = [tuple(dc[i : i + w]) for i in range(len(dc) - w + 1)]
        for k, it in items:
            iraw, ic = canon(it)
            iw = [tuple(ic[i : i + w]) for i in range(len(ic) - w + 1)]
            plain = {x for x in iw if any(c[0] != "<" for c in x)}
            if not plain or len(plain & set(dw)) < need * len(plain):
                continue
            offs = [j - i for j, y in enumerate(dw) for i, x in enumerate(iw) if x == y and x in plain]
            off = min(set(offs), key=lambda o: (-offs.count(o), o))
            slots = set()
            for i in range(len(iw)):
                if 0 <= i + off < len(dw) and iw[i] == dw[i + off] and iw[i] in plain:
                    slots |= {(ic[j], iraw[j], draw[j + off]) for j in range(i, i + w) if ic[j][0] == "<"}
            if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                got.append((d, k, len(plain & set(dw)), len(slots), "exact" if all(s[1] == s[2] for s in slots) else "template"))
    return sorted(got, key=str)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_matched, r.n_slots, r.kind) for r in leaks(docs, items).collect()), key=str)
    assert got == brute(DOCS, ITEMS)
    assert {(g[0], g[1], g[4]) for g in got} == {(10, 1, "exact"), (11, 1, "template"), (13, 2, "exact"), (None, 2, "exact"), (10, 2, "exact")}
    left = drop_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [12, 14, 15, 16, 17]
    assert leaks(docs.limit(0), items).collect() == [] and drop_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_planted_passages(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = {r.doc_id: re.sub(r"\s+", " ", r.text) for r in docs.collect()}
    want = {(k, r.item_id) for r in items.collect() for k, t in texts.items() if re.sub(r"\s+", " ", r.text) in t}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)


def test_short_items_at_every_offset(spark):
    items = [(6, "alpha beta gamma delta epsilon zeta"), (7, "one two three four five six seven"), (3, "Kappa lambda mu")]
    docs = [(k * 10 + pad, " ".join(["pad"] * pad + [t] + ["tail"])) for k, t in items for pad in range(4)]
    docs.append((99, "alpha beta gamma delta epsilon pad lambda mu"))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(k * 10 + pad, k, "exact") for k, _ in items for pad in range(4)} and len(got) == 12


def test_mapping_is_a_function_with_tolerance(spark):
    item = "a farmer sells 12 apples and 5 pears at 3 stalls then 4 plums in 6 towns"
    docs = [
        (1, item.replace("12", "7").replace("5", "7")),  # two values become one
        (2, "farm 9 kg " + item.replace("12", "7")),
        (3, item + " and so on; " + item.replace("12", "99")),
        (4, "5 of Ann and 5 of Ann"),
    ]
    items = [(1, item), (2, "5 plus 5"), (3, "Ann has 1 hat, Ann has 1 hat, Bob has 2 hats, Bob has 2 hats and Ann has 1 hat")]
    docs += [(5, "5 plus 6 is not 5 plus 5"), (6, "5 plus 6"), (7, items[2][1].replace("Bob", "Eve", 1)), (8, items[2][1].replace("Ann", "Eve", 1).replace("Bob", "Eve", 1).replace("1", "3", 1).replace("2", "3", 1))]
    got = {(r.doc_id, r.item_id, r.kind) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, "template"), (2, 1, "template"), (3, 1, "exact"), (5, 2, "exact"), (7, 3, "template")}


def test_very_long_text(spark):
    """An item at the end of a text of 200,000 words, and an item that is as long itself."""
    filler = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(200_000))
    docs = spark.createDataFrame([(1, filler + " " + ITEMS[1][1]), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(2, ITEMS[1][1]), (9, " ".join(f"q{chr(97 + k % 26)}" for k in range(30_000)))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.kind) for r in leaks(docs, items).collect()]
    assert got == [(1, 2, "exact")]
