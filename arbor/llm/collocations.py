"""Phrase collocations: n-grams as rows, counted per language, scored by their parts, extensions kept, ranked.

1. Sieve. A phrase that occurs `min_count` times has only parts that do so. Cells of documents send short hashes of their
   2-grams, then of the 3-grams whose two parts may be frequent, and so on, to buckets, which answer one bit each. Hashes
   that meet only let more through, so nothing frequent is lost, and rare n-grams, most of all, never become rows.
2. All words, and the n-grams that passed, become rows (lang, phrase, count of the cell), hash-aggregated per language on the strings
   themselves, so counts are exact.
3. Every cut of a candidate is joined with the counts of its first part and of its rest; scores are Decimal and divided without
   rounding; the lowest cut counts, then the smallest k.
4. Candidates with a one-word extension that is frequent enough are dropped by an anti-join. A longer phrase is no more frequent
   than the extension inside it, so one word is enough.
5. Ranks by windows over language and share, three times, so a language with most rows is sorted by many tasks.

Rules. A-Z are lower-cased; pieces end at `[.,;:!?\\x0A-\\x0D]`; words are `[^\\x20\\x09]+` of a piece; phrases stay inside pieces and
overlap. Null texts are empty; a null lang is `und` (and one group with it). Ids, also null or repeated ones, only deal rows to cells; every row
counts, repeated ones too. Ties are broken by a, then by the phrase in UTF-8 byte order. Texts may be of any length; other
columns are ignored; an empty table gives an empty result. Counts are cut from their lineage by checkpoint().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm import cells as C
from arbor.llm.shared import ensure_checkpoint_dir, release
from arbor.llm.textnum import bucket_of, mix, utf8, windows
from arbor.llm.textruns import Kind, outside, runs, strings

_U = np.uint64
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECE = ~outside(_ENDS)
_WORDS = Kind(outside(_ENDS + b" \t"))
_SENT = "bucket int, cell int, kind int, data binary"
_ANSWER = "cell int, bucket int, kind int, data binary"
_GRAM = "lang string, phrase string, n long"
#: Shares of a language in the windows, from the first to the last.
SHARES = (4096, 64, 1)


class _Words:
    """The words of a cell: places, hashes with the language folded in, and where pieces begin."""

    def __init__(self, table: pa.Table):
        self.data, offsets = utf8(table["text"])
        self.start, self.end, h, first = runs(self.data, offsets, _WORDS)
        doc = np.repeat(np.arange(len(table)), np.diff(first))
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs, code = langs.dictionary, np.asarray(langs.indices, np.int64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], _U)
        self.lang = code[doc]
        self.h = mix(h ^ seeds[self.lang]) if len(h) else h
        breaks = np.cumsum(_PIECE[self.data], dtype=np.int64)
        at = breaks[self.start] if len(h) else h.astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        self.first = np.concatenate([np.flatnonzero(new), [len(h)]]).astype(np.int64)

    def level(self, k: int, alive: np.ndarray):
        """Windows of k words that may be frequent, their distinct hashes, the entry of each and how often each occurs."""
        w, ok = windows(self.h, self.first, k)
        may = ok.copy()
        may[:-1] &= alive[:-1] & alive[1:]
        have, where, times = np.unique(w[may[ok]], return_inverse=True, return_counts=True)
        return may, have, where, times

    def passed(self, top: int, answers: pa.Table, n: int):
        """For 1 to top: which words begin an n-gram that may be frequent."""
        alive = [np.ones(len(self.h), bool)]
        for k in range(2, top + 1):
            may, have, where, _ = self.level(k, alive[-1])
            hit = C.spread(C.unpack(answers, k, n), bucket_of(have, n)).astype(bool)
            may[may] = hit[where]
            alive.append(may)
        return alive


def _ask(n: int, k: int):
    def run(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        release("collocations")
        rows, cell = [], 0
        if len(table):
            cell, x = table["cell"][0].as_py(), _Words(table)
            alive = x.passed(k - 1, answers, n)[-1]
            _, have, _, times = x.level(k, alive)
            low, times, bounds = (have & _U(0xFFFFFFFF)).astype(np.uint32), np.minimum(times, 255).astype(np.uint8), bucket_of(have, n)
            rows = [(b, times[x:y].tobytes() + low[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "cell": pa.array([cell] * len(rows), pa.int32()), "kind": pa.array([k] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _ask_first(n: int):
    ask = _ask(n, 2)
    return lambda table: ask(table)


def _answer(least: int):
    """One bit for every hash sent: it, or one that looks like it, occurs at least so often. A cell tells of 255 times at most, which is enough."""

    def run(table: pa.Table) -> pa.Table:
        cells, data = table["cell"].to_pylist(), table["data"].to_pylist()
        sizes = [len(d) // 5 for d in data]
        times = np.concatenate([np.frombuffer(d, np.uint8, n) for d, n in zip(data, sizes)])
        low = np.concatenate([np.frombuffer(d[n:], np.uint32) for d, n in zip(data, sizes)])
        _, where = np.unique(low, return_inverse=True)
        hit = (np.bincount(where, times) >= min(least, 255))[where]
        b, kind = table["bucket"][0].as_py(), table["kind"][0].as_py()
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]
        return pa.table({"cell": pa.array(cells, pa.int32()), "bucket": pa.array([b] * len(cells), pa.int32()), "kind": pa.array([kind] * len(cells), pa.int32()), "data": pa.array(bits, pa.binary())})

    return run


def _emit(n: int, top: int):
    """(lang, phrase, n) of a cell, and one row a language without phrase that counts its words."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        release("collocations")
        out = []
        if len(table):
            x = _Words(table)
            word = strings(x.data, x.start, x.end)
            alive = x.passed(top, answers, n)
            for k, here in enumerate(alive, 1):
                at = np.flatnonzero(here)
                parts = [word.take(pa.array(at + j)) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                grams = pa.table({"lang": pa.array(x.lang[at], pa.int64()), "phrase": phrase})
                got = grams.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                out.append(pa.table({"lang": x.langs.take(got["lang"].combine_chunks()).cast(pa.string()), "phrase": got["phrase"].cast(pa.string()), "n": got["count_all"].cast(pa.int64())}))
            total = np.bincount(x.lang, minlength=len(x.langs))
            out.append(pa.table({"lang": x.langs.cast(pa.string()), "phrase": pa.array([None] * len(x.langs), pa.string()), "n": pa.array(total, pa.int64())}))
        none = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]).empty_table()
        return pa.concat_tables([none, *out]).combine_chunks()

    return run


def phrase_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_n: int = 3, min_count: int = 10, cell_bytes: int = C.CELL_BYTES) -> DataFrame:
    """(lang, phrase, n) of all phrases of 1 to max_n words that occur min_count times, and (lang, null, number of words) of every language."""
    if max_n < 2 or min_count < 1:
        raise ValueError("max_n >= 2 and min_count >= 1")
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    n = C.n_cells(docs, "text", cell_bytes)
    dealt = docs.withColumn("cell", C.cell_of(n, "id", "text")).drop("id")
    answers = dealt.groupBy("cell").applyInArrow(_ask_first(n), _SENT).groupBy("bucket").applyInArrow(_answer(min_count), _ANSWER)
    for k in range(3, max_n + 1):
        asked = dealt.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(_ask(n, k), _SENT)
        answers = answers.unionByName(asked.groupBy("bucket").applyInArrow(_answer(min_count), _ANSWER))
    grams = dealt.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(_emit(n, max_n), _GRAM)
    return grams.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= min_count))


def scored(counts: DataFrame, max_n: int = 3) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all phrases of two words and more: the lowest cut, then the smallest k."""
    c = counts.where("phrase is not null").withColumn("words", F.size(F.split("phrase", " ")))
    cand = c.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = []
    for n in range(2, max_n + 1):
        for k in range(1, n):
            cuts.append(F.when(F.col("words") == n, F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.substring_index("phrase", " ", k - n).alias("right"))))
    cut = cand.select("*", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    part = lambda name, to: c.select("lang", F.col("phrase").alias(name), F.col("n").alias(to))
    whole = lambda x: F.col(x).cast("decimal(18,0)")
    both = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    top, bottom = (F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a"))).cast("decimal(38,0)"), whole("l") * whole("r")
    both = both.withColumn("top", top).withColumn("bottom", bottom).withColumn("score", F.expr("top div bottom"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return both.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def without_extended(cand: DataFrame, percent: int = 50) -> DataFrame:
    """The candidates that lie in no longer one with at least so many hundredths of their number."""
    longer = cand.where("words > 2")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    most = longer.select("lang", "a", inner.alias("inner")).groupBy("lang", "inner").agg(F.max("a").alias("most"))
    gone = cand.select("lang", "phrase", "a").join(most.withColumnRenamed("inner", "phrase"), ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("a") * percent)
    return cand.join(gone.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_n: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000, cell_bytes: int = C.CELL_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of every language."""
    ensure_checkpoint_dir(docs.sparkSession)
    counts = phrase_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, max_n=max_n, min_count=min_count, cell_bytes=cell_bytes).checkpoint()
    left = without_extended(scored(counts, max_n).checkpoint(), percent)
    for shares in SHARES:
        by = [F.col("lang"), F.pmod(F.xxhash64("phrase"), F.lit(shares))] if shares > 1 else [F.col("lang")]
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        left = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    words = counts.where("phrase is null").select("lang", "n")  # one row a language
    return left.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
