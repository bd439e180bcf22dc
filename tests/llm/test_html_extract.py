import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from arbor.llm.html_extract import extract, parse, page_counts, repeats, shared, suffix_array


def text_of(html):
    return "\n".join(t for z, t in parse(html)[1] if z == "content")


def test_zones_and_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></ul></nav><!-- ad --><div class="ad">buy</div><header><h1>Site</h1></header>
    <article class="post"><header><h1>Title &amp; <b>more</b></h1></header><p>One  two<p><b>unclosed<br><p>a&nbsp;b &lt;c&gt;
    <div class="share"><p>share me</div><aside>side</aside><form><p>mail</form><ul><li>x<li>y</ul>
    <section id="comments"><p>first!</section><p>last</article><p>after</p><footer>&copy; f</footer></body>"""
    assert text_of(page) == "Title & more\nOne two\nunclosed\na b <c>\nx\ny\nlast"
    assert text_of("<main>1 < 2 <br>x</main>") == "1 < 2\nx" and text_of("") == "" and text_of("<article>a<script>") == "a"


def brute_repeats(pages, least):
    """Flags of each page's tokens, by comparing all substrings with each other."""
    streams = [[x for b in p for x in ["|", *b]] for p in pages]
    subs = [[tuple(s[a : a + least]) for a in range(len(s) - least + 1)] for s in streams]
    on = Counter(w for s in subs for w in set(s))
    out = []
    for s, own in zip(streams, subs):
        rarest, cover = min((on[w] for w in own), default=0), set()
        for a, w in enumerate(own):
            if on[w] > rarest:
                cover.update(range(a, a + least))
        out.append([k in cover for k, x in enumerate(s) if x != "|"])
    return out


def test_suffix_array_equals_brute_force():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 40, 90):
        for _ in range(10):
            s = [r.randrange(3) for _ in range(n)]
            page = np.sort(np.array([r.randrange(4) for _ in range(n)], np.int64))
            order, common = suffix_array(np.array(s, np.int64))
            assert order.tolist() == sorted(range(n), key=lambda i: s[i:])
            lcp = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
            assert common.tolist()[1:] == [lcp(i, j) for i, j in zip(order.tolist(), order.tolist()[1:])]
            assert shared(order, common, page).tolist() == [max((lcp(i, j) for j in range(n) if page[j] != page[i]), default=0) for i in range(n)]
            whole = [i for i in range(n) if i + 3 <= n]
            counts = page_counts(order, common, page, 3)[1]
            assert [counts[i] for i in whole] == [len({page[j] for j in whole if s[j : j + 3] == s[i : i + 3]}) for i in whole]


def test_repeats_equal_brute_force():
    r = random.Random(2)
    for _ in range(40):
        pages = [[[r.choice("abc") for _ in range(r.randrange(9))] for _ in range(r.randrange(4))] for _ in range(5)]
        got = [[x for b in p for x in b.tolist()] for p in repeats(pages, 4)[0]]
        assert got == brute_repeats(pages, 4)


def brute_extract(rows, least=8):
    """The whole query: hosts, zones, repeats over all pages of a host, kept runs."""
    hosts, out = {}, []
    for i, url, html in rows:
        hosts.setdefault((url or "").split("/")[2] if "//" in (url or "") else "", []).append((i, *parse(html or "")))
    for pages in hosts.values():
        outside = [[t.split() for z, t in blocks if z != "content"] for _, _, blocks in pages]
        for (i, decided, blocks), own, flags in zip(pages, outside, brute_repeats(outside, least)):
            kept, at, gone = [], 0, 0
            for (z, _), words in zip([b for b in blocks if b[0] != "content"], own):
                f = flags[at : at + len(words)]
                at += len(words)
                runs, k = [], 0
                while k < len(f):
                    e = next((x for x in range(k, len(f)) if f[x] != f[k]), len(f))
                    runs.append((k, e, f[k]))
                    k = e
                out_of = {x for a, e, g in runs if g and (e - a >= least or e - a == len(f)) for x in range(a, e)}
                gone += len(out_of)
                if z == "open":
                    kept.append(" ".join(w for x, w in enumerate(words) if x not in out_of))
            text = "\n".join(t for z, t in blocks if z == "content") if decided else "\n".join(t for t in kept if t)
            out.append((i, text, sum(map(len, own)), gone))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    r = random.Random(8)
    rows = []
    for host in ("a.example", "b.example", "c.example"):
        word = lambda: r.choice("lorem ipsum dolor sit amet elit sed do tempor magna".split()) + str(r.randrange(9))
        fixed = [" ".join(f"{host[0]}{k}m{j}" for j in range(r.randrange(5, 14))) for k in range(4)]
        bodies = ["".join(f"<p>{' '.join(word() for _ in range(r.randrange(1, 15)))}</p>" for _ in range(3)) for _ in range(12)]
        for i in range(40):
            body = r.choice(bodies) if r.random() < 0.5 else "".join(f"<p>{' '.join(word() for _ in range(r.randrange(1, 15)))}</p>" for _ in range(2))
            inner = f"<article>{body}</article>" if r.random() < 0.2 else f"<div class='q{i % 3}'>{body}</div>"
            page = "".join(f"<div class='z{k}'>{t}</div>" for k, t in enumerate(fixed[:2])) + inner + f"<section class='zz'>{fixed[2]} {r.choice(['', 'today ' + word()])}</section><footer>{fixed[3]}</footer>"
            rows.append((len(rows), f"https://{host}/p{i}", page))
    rows += [(None, "https://a.example/n", rows[3][2]), (5, None, rows[4][2]), (6, "odd", None), rows[7]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, text int")
    want = brute_extract(rows)
    for n in (1000, 9):
        got = sorted(((x.page_id, x.text, x.n_outside, x.n_repeated) for x in extract(df, part_pages=n).collect()), key=str)
        assert got == want
    assert sum(w[3] for w in want) > 1000


def test_copies_of_a_page_keep_their_text(spark):
    menu = "<div>" + " ".join(f"menu{k}" for k in range(9)) + "</div>"
    text = " ".join(f"own{k}" for k in range(30))
    rows = [(i, "http://h.example/", f"{menu}<p>{text}</p>") for i in range(3)] + [(9, "http://h.example/x", f"{menu}<p>{' '.join(f'x{k}' for k in range(20))}</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == got[2] == text and got[9].startswith("x0 x1")


def test_very_long_page(spark):
    long = "<article>" + "<p>word and more</p>" * 60_000 + "</article>"
    rows = [(1, "http://h.example/", long), (2, "http://h.example/2", "<p>" + "one two three " * 60_000 + "</p>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].count("\n") == 59_999 and got[2].count("one") == 60_000


def test_pages_without_article_keep_unique_runs(spark):
    menu = "<div><p>home and about and contact and imprint of this site</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}<p>unique text number {i} about page {i * 7}</p></body>", "x") for i in range(6)]
    rows += [(10, None, None, "x"), (11, "http://h.example/a", "<article>home and about and contact and imprint of this site</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract(df).collect()}
    assert all(got[i].text == f"unique text number {i} about page {i * 7}" for i in range(6))
    assert got[10].text == "" and got[11].text == "home and about and contact and imprint of this site"
    assert all(r.n_chars == len(r.text) for r in got.values()) and extract(df.limit(0)).collect() == []


def test_parts_change_no_result(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        # page i and page i + 30 share one sentence that no other page has
        shared = " ".join(f"s{i % 30}w{k}" for k in range(10))
        rows.append((i, f"http://big.example/{i}", f"<body><p>site menu for all of the pages of this host</p><p>page {i} {shared} end {i}</p><p>{r.random()} own words {i}</p></body>"))
    rows += [(100, "http://big.example/a", "<body><aside>" + " ".join(f"s3w{k}" for k in range(10)) + "</aside><article>text</article></body>"), (0, *rows[0][1:]), (200, "http://small.example/", rows[1][2]), (101, "http://big.example/e", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = (sorted((x.page_id, x.url, x.text) for x in extract(df, part_pages=n).collect()) for n in (1000, 7))
    assert whole == dealt and len(whole) == len(rows)
    got = {x[0]: x[2] for x in dealt}
    assert not any("s" + str(i % 30) + "w5" in got[i] for i in range(60)) and "s1w5" in got[200]


def test_given_pages_without_their_article_tags(spark):
    """What the suffix array and open blocks make of the given pages once article and main are plain div elements, against the text with the tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", r"(?i)<(/?)(?:article|main)\b", "<$1div"))
    unnamed = plain.withColumn("html", F.regexp_replace("html", r"(?i)\s(?:class|id|role)=\"[^\"]*\"", ""))
    want = {r.page_id: Counter(r.text.split()) for r in extract(pages).collect()}
    size = sum(sum(w.values()) for w in want.values())

    def kept_and_extra(df):
        got = {r.page_id: Counter(r.text.split()) for r in extract(df).collect()}
        assert got.keys() == want.keys()
        kept = sum(sum((got[k] & want[k]).values()) for k in want)
        return kept, sum(sum(g.values()) for g in got.values()) - kept

    kept, extra = kept_and_extra(plain)
    assert kept >= 0.99 * size and extra == 0
    kept, extra = kept_and_extra(unnamed)  # without class names too, adverts that stand on one page stay
    assert kept >= 0.99 * size and extra <= 0.03 * size
