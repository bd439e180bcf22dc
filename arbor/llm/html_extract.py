"""Main text of web pages: a suffix array over each host's page streams, with markup as the prior.

Pages are parsed into blocks, each in a zone. Blocks in an article or main element are content unless an element
inside marks them as menu, advert, form, comments and so on; blocks marked so are noise wherever they are; the
rest is open. The blocks outside content of all pages of a host are joined to one token stream with separators. A
suffix array over it with the lengths of common prefixes tells, for each place, the longest substring that
another page has too, and how many pages have its first MIN_REPEAT tokens.

1. A run of at least MIN_REPEAT tokens is boilerplate if more pages have it than have the rarest run of its page. The
   rarest run of a page without copies stands on one page; that of one of k copies stands on k, so copies of a
   page keep what is their own.
2. What the suffix array leaves outside content is kept where the page has no article or main element and
   markup calls it open. So a menu under an unknown name goes because it repeats, and an advert or comment that
   stands on one page goes because of its markup, which no repeat could tell.
3. Text that markup names as the article is kept whole: articles in copies, and lines that articles share, are
   text of the article.

Hosts with more than PART_PAGES pages are dealt to parts by page id, so a host with a third of all pages is many
tasks. Each part counts the pages of its substrings of MIN_REPEAT tokens by its suffix array and sends the distinct
hashes, once each with the count, to buckets of the host; a bucket answers with the count over all parts. So the
number of parts changes no result; what parts share is told by 64-bit hashes.

Rules. Null or empty html, and pages without kept blocks, have empty text. A null or odd url has host "".
Broken markup is read as far as it goes: unknown or unclosed elements end with their parent. Rows keep their
number; null ids are allowed; repeated rows are pages of their own, and so copies; other columns are dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.shared import release
from arbor.llm.textnum import bucket_of, windows

PART_PAGES = 1000
MIN_REPEAT = 8
BROADCAST_HOSTS = 100_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_NOISE_TAGS = frozenset("nav footer aside form dialog menu button head".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|widget|complementary|contentinfo|search)(?:$|[\s_-])", re.I)


def _is_noise(tag: str, attrs: str) -> bool:
    if tag in _NOISE_TAGS:
        return True
    if tag in ("body", "html", "article", "main") or not attrs:
        return False
    return any(_NOISE_WORDS.search(next(filter(None, m.groups()), "")) for m in _ATTR.finditer(attrs))


def parse(html: str) -> tuple[bool, list[tuple[str, str]]]:
    """(has an article or main element, blocks as (zone, text)); zone: content, noise or open."""
    stack: list[tuple[str, str]] = []
    blocks: list[tuple[str, str]] = []
    buf: list[str] = []
    zone, seen, at, n = "open", False, 0, len(html)

    def flush():
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if text:
                blocks.append((zone, text))
            buf.clear()

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            buf.append(html[at:])
            break
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != zone:
                        flush()
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag in _RAW:
            if m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in _VOID:
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag not in _INLINE else None)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    zone = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] not in _INLINE:
                    break
        stack.append((tag, zone))
        new = zone
        if tag in _CONTENT_TAGS and zone != "noise":
            seen, new = True, "content"
        elif _is_noise(tag, m[3]) or tag == "header" and zone != "content":
            new = "noise"
        if new != zone:
            flush()
            zone = new
    flush()
    return seen, blocks


def _stream(pages: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the tokens of all blocks of all pages, the page of each, and hashes of the tokens.

    A sign stands where a block begins, and another, of which each page has its own, after the last block of a page.
    """
    flat = [t for p in pages for b in p for t in ("", *b)]  # no token is empty
    kinds, where = np.unique(np.array(flat, object), return_inverse=True) if flat else (np.zeros(0, object), np.zeros(0, np.int64))
    own = np.array([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in kinds], np.uint64)
    sizes = np.array([sum(len(b) + 1 for b in p) for p in pages], np.int64)
    ends = np.cumsum(sizes)
    ranks = np.insert(where.astype(np.int64) + len(pages), ends, np.arange(len(pages)))
    return ranks, np.repeat(np.arange(len(pages)), sizes + 1), np.insert(own[where], ends, 0)


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and the length of the prefix that each shares with the one before it (0 for the first).

    Ranks of substrings of 1, 2, 4, ... tokens, until all differ; the same ranks then add up to the common prefixes.
    """
    n = len(stream)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = [np.unique(stream, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while ranks[-1].max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - width)] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1])
    common = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 2, -1, -1):
        inside = (x + (1 << k) <= n) & (y + (1 << k) <= n)
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        common[1:][same] += 1 << k
        x[same] += 1 << k
        y[same] += 1 << k
    return order, common


def shared(order: np.ndarray, common: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each place of the stream, the length of the longest substring from there that another page has too."""

    def before(pages: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Prefix shared with the last suffix before that is of another page: the least length since then."""
        new = np.concatenate([[True], pages[1:] != pages[:-1]])
        far = int(lcp.max()) + 1
        run = np.cumsum(new)
        return np.minimum.accumulate(lcp - run * far) + run * far

    out = np.zeros(len(order), np.int64)
    if len(order):
        p, up = page[order], np.concatenate([common[1:], [0]])
        out[order] = np.maximum(before(p, common), before(p[::-1], up[::-1])[::-1])
    return out


def page_counts(order: np.ndarray, common: np.ndarray, page: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each place, a number of its substring of `least` tokens (places with the same have the same), and on how many pages that is."""
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(common < least)
    pairs = np.unique(group * (len(page) + 1) + page) if len(page) else group
    return group, np.bincount(pairs // (len(page) + 1), minlength=int(group.max()) + 1 if len(group) else 0)[group]


def _inside(pages: list[list[list[str]]], least: int) -> np.ndarray:
    """Which places of the stream begin a substring of `least` tokens inside a page."""
    sizes = [sum(len(b) + 1 for b in p) for p in pages]
    return np.concatenate([np.arange(n + 1) + least <= n for n in sizes]) if sizes else np.zeros(0, bool)


def repeats(pages: list[list[list[str]]], least: int = MIN_REPEAT, counts: np.ndarray | None = None) -> tuple[list[list[np.ndarray]], list[int]]:
    """For the blocks of each page, which tokens lie in a run that more pages have than have the page's rarest run; and the pages of that.

    counts: for each place of the stream, how many pages of the host have its substring of `least` tokens, where the
    pages given are only a part of them.
    """
    ranks, page, _ = _stream(pages)
    order, common = suffix_array(ranks)
    inside = _inside(pages, least)
    n = len(ranks)
    rarest = np.full(len(pages), n + 1, np.int64)
    if counts is None:
        counts = page_counts(order, common, page, least)[1]
        length = shared(order, common, page)
    else:
        length = np.where(inside & (counts > 1), least, 0)
    np.minimum.at(rarest, page[inside], counts[inside])
    hit = np.flatnonzero(inside & (counts > rarest[page]) & (length >= least))
    # a maximal repeat holds a hit at each of its first tokens, so covering `least` tokens of each covers it whole
    cover = np.zeros(n + least + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + least, -1)
    covered = np.cumsum(cover)[:n] > 0
    out, at = [], 0
    for blocks in pages:
        own = []
        for b in blocks:
            own.append(covered[at + 1 : at + 1 + len(b)])
            at += 1 + len(b)
        at += 1
        out.append(own)
    return out, [int(k) if k <= n else 0 for k in rarest]


def boilerplate(covered: np.ndarray, least: int = MIN_REPEAT) -> np.ndarray:
    """Covered runs of a block that fill it or have at least that many tokens; a shorter run is the edge of a neighbour's."""
    if covered.all():
        return covered
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= least
    return out


_SENT = "host string, bucket int, part int, data binary"
_ANSWER = "host string, part int, bucket int, data binary"
_PARSED = "page_id long, url string, host string, part int, parts int, decided boolean, text string, zones array<string>, blocks array<string>"
_OUT = "page_id long, url string, text string, n_chars long, n_outside long, n_repeated long"


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 on in four bytes more."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """n counts, and the bytes they take."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(data, np.uint32, int(large.sum()), n)
    return out, n + 4 * int(large.sum())


def _parse_batches(batches):
    for b in batches:
        rows = []
        for h in b.column("html").to_pylist():
            decided, blocks = parse(h or "")
            outside = [x for x in blocks if x[0] != "content"]
            rows.append((decided, "\n".join(t for z, t in blocks if z == "content"), [z for z, _ in outside], [t for _, t in outside]))
        cols = [b.column(c) for c in ("page_id", "url", "host", "part", "parts")]
        kinds = (pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.record_batch(cols + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "url", "host", "part", "parts", "decided", "text", "zones", "blocks"])


def _tokens(table: pa.Table) -> list[list[list[str]]]:
    return [[b.split() for b in p] for p in table["blocks"].to_pylist()]


def _hashes(pages: list[list[list[str]]], least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of `least` tokens inside a page, and their places in the stream."""
    ranks, _, own = _stream(pages)
    h, ok = windows(own, np.array([0, len(own)], np.int64), least)
    at = np.flatnonzero(ok)
    inside = _inside(pages, least)[at]
    return h[inside], at[inside]


def _ask(table: pa.Table) -> pa.Table:
    parts = table["parts"][0].as_py()
    rows = []
    if parts > 1:
        pages = _tokens(table)
        ranks, page, _ = _stream(pages)
        counts = page_counts(*suffix_array(ranks), page)[1]
        h, at = _hashes(pages)
        have, first = np.unique(h, return_index=True)
        many, bounds = counts[at[first]], bucket_of(have, parts)
        rows = [(b, np.int64(y - x).tobytes() + have[x:y].tobytes() + _packed(many[x:y])) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
    host, part = table["host"][0].as_py(), table["part"][0].as_py()
    return pa.table({"host": pa.array([host] * len(rows), pa.string()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """For every hash sent, how many pages of the host have it."""
    have, counts = [], []
    for d in table["data"].to_pylist():
        n = int(np.frombuffer(d, np.int64, 1)[0])
        have.append(np.frombuffer(d, np.uint64, n, 8))
        counts.append(_unpacked(d[8 + 8 * n :], n)[0])
    sizes = [len(x) for x in have]
    _, where = np.unique(np.concatenate(have), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
    data = [_packed(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
    return pa.table({"host": table["host"], "part": table["part"], "bucket": table["bucket"], "data": pa.array(data, pa.binary())})


def _counts(pages: list[list[list[str]]], parts: int, answers: pa.Table) -> np.ndarray:
    """For each place of the stream, how many pages of the host have its substring."""
    h, at = _hashes(pages)
    have = np.unique(h)
    bounds = bucket_of(have, parts)
    total = np.zeros(len(have), np.int64)
    for b, d in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()):
        total[bounds[b] : bounds[b + 1]] = _unpacked(d, int(bounds[b + 1] - bounds[b]))[0]
    out = np.zeros(sum(sum(len(b) + 1 for b in p) + 1 for p in pages), np.int64)
    out[at] = total[np.searchsorted(have, h)]
    return out


def _extract(table: pa.Table, answers: pa.Table) -> pa.Table:
    release("html_extract")
    pages = _tokens(table)
    decided, zones, texts = table["decided"].to_pylist(), table["zones"].to_pylist(), table["text"].to_pylist()
    parts = table["parts"][0].as_py() if len(table) else 1
    flags, _ = repeats(pages, counts=_counts(pages, parts, answers) if parts > 1 else None)
    outside, repeated = [], []
    for i, (blocks, own) in enumerate(zip(pages, flags)):
        gone = [boilerplate(c) for c in own]
        outside.append(sum(map(len, blocks)))
        repeated.append(int(sum(g.sum() for g in gone)))
        if not decided[i]:
            runs = [" ".join(t for t, out in zip(b, g.tolist()) if not out) for z, b, g in zip(zones[i], blocks, gone) if z == "open"]
            texts[i] = "\n".join(r for r in runs if r)
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_outside": pa.array(outside, pa.int64()), "n_repeated": pa.array(repeated, pa.int64())})


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page; n_outside: tokens outside content, n_repeated: those in runs the suffix array removes."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    parts = p.groupBy("host").agg(F.ceil(F.count("*") / part_pages).cast("int").alias("parts"))
    if parts.count() <= BROADCAST_HOSTS:  # beyond, Spark shuffles and splits hot hosts
        parts = F.broadcast(parts)
    dealt = p.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int"))
    parsed = dealt.select("page_id", "url", "host", "part", "parts", "html").mapInArrow(_parse_batches, _PARSED)
    answers = parsed.groupBy("host", "part").applyInArrow(_ask, _SENT).groupBy("host", "bucket").applyInArrow(_answer, _ANSWER)
    return parsed.groupBy("host", "part").cogroup(answers.groupBy("host", "part")).applyInArrow(_extract, _OUT)
