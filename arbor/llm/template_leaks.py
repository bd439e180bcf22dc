"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Tokens are runs of letters or numbers. Numbers, units after a number, and capitalised words become typed
placeholders; other words are lower-cased. Windows of WINDOW canonical tokens are hashed at every token of the
benchmark and of the documents and joined by hash, so every shared passage of WINDOW tokens meets, wherever it
stands. An item of fewer tokens is one window of its own length, and the documents are asked for those lengths
too. For each pair (document, item) that meets, all windows of both are compared: coverage is the share of the
item's distinct windows in the document. The windows that lie at the commonest distance of positions are then
aligned (at each of them, if several are equally common, and the best is taken), and the slot values of the
item must map to those of the document as a function: of the slots, at least AGREEMENT have the value that is
the commonest for their item value. Two item values may have the same document value. A pair is a leak if
coverage is at least COVERAGE and its slots agree; it is `exact` if all slots have the item's values, else
`template`, a question with other parameters.

Names are capitalised words, so the first word of a sentence counts as one, in items and documents alike; units are UNITS.

Rules. Null and empty texts have no tokens. Windows of placeholders alone are not used. An item of one or two
common words is found in every document that has them. Repeated items and documents each give their own rows;
extra columns are ignored; empty tables give an empty result.

Scale. Documents send one row for each distinct window to a hash join with the benchmark's windows, which are
broadcast only below BROADCAST_WINDOWS (they are counted first). Only documents with a common window are read
again, by a join on a row key, and windows that many documents share are one row of the build side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 6
COVERAGE = 0.5
#: Share of the aligned slots that must have the commonest document value of their item value.
AGREEMENT = 0.8
BROADCAST_WINDOWS = 500_000
#: Units that count as a slot after a number.
UNITS = "mm cm m km g mg kg t lb lbs oz l ml s ms min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years inch inches foot feet mile miles meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees mph kmh pesos francs".split()
TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}+"
NUMBER, UNIT, NAME = "", "", ""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(t: Column) -> Column:
    return t.rlike(r"^\p{N}")


def canonical(toks: Column) -> Column:
    """Placeholders and lower-cased words, one for each token."""

    def one(t, i):
        low, tail = F.lower(t), F.substring(t, 2, 1 << 30)
        before = F.get(toks, i - 1)
        plain = (low == t) & (low >= "a")
        return (
            F.when(plain & ~low.isin(UNITS), low)
            .when(_is_number(t), F.lit(NUMBER))
            .when(low.isin(UNITS) & F.coalesce(_is_number(before), F.lit(False)), F.lit(UNIT))
            .when((low != t) & (tail != "") & (tail == F.lower(tail)), F.lit(NAME))
            .otherwise(low)
        )

    return F.transform(toks, one)


def _let(value: Column, f) -> Column:
    """f(value) with value evaluated once, as the optimizer does not look into lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hashes(canon: Column, window: int | Column) -> Column:
    """Array of hashes of windows that hold a plain word; none for shorter arrays."""
    starts = F.when(F.size(canon) >= window, F.sequence(F.lit(1), F.size(canon) - (window - 1))).otherwise(F.array().cast("array<int>"))

    def one(i):
        w = F.slice(canon, i, window)
        return F.when(F.exists(w, lambda x: ~x.isin(NUMBER, UNIT, NAME)), F.xxhash64(w))

    return F.transform(starts, one)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, n_slots, kind (exact or template) and row_key of every leak."""
    # written after each step, as an expression that gets into a lambda is evaluated for every token
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("itok")).checkpoint()
    items = items.withColumn("ican", canonical(F.col("itok"))).checkpoint()
    items = items.withColumn("width", F.least(F.greatest(F.size("ican"), F.lit(1)), F.lit(window))).withColumn("iwin", _hashes(F.col("ican"), F.col("width"))).withColumn("item_key", F.xxhash64("item_id", "itok"))
    index = items.select(F.explode("iwin").alias("w")).where("w is not null").distinct()
    if index.count() <= BROADCAST_WINDOWS:
        index = F.broadcast(index)
    widths = sorted({window} | {r.width for r in items.where("size(ican) > 0").select("width").distinct().collect()})
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_key"))
    probe = keyed.select("row_key", F.explode(_let(tokens(F.col("text")), lambda t: _let(canonical(t), lambda c: F.array_distinct(F.concat(*[_hashes(c, k) for k in widths]))))).alias("w")).where("w is not null")
    met = probe.join(index, "w").select("row_key").distinct().checkpoint()
    rows = met
    if rows.count() <= BROADCAST_WINDOWS:
        rows = F.broadcast(rows)
    found = keyed.join(rows, "row_key").select("row_key", "doc_id", tokens(F.col("text")).alias("dtok")).checkpoint()
    once = found.select("row_key", "dtok").dropDuplicates(["row_key"])

    iwin = items.select("item_key", "width", F.posexplode("iwin").alias("k", "w")).where("w is not null").distinct().checkpoint()
    total = iwin.groupBy("item_key").agg(F.countDistinct("w").alias("n_windows"))
    # a window of few common words stands in most documents, so they are not shuffled by it while the benchmark's windows are few
    asked = F.broadcast(iwin) if iwin.count() <= BROADCAST_WINDOWS else iwin
    by_width = F.explode(_let(canonical(F.col("dtok")), lambda c: F.array(*[F.struct(F.lit(k).alias("width"), _hashes(c, k).alias("dwin")) for k in widths])))
    dwin = once.select("row_key", by_width.alias("x")).select("row_key", "x.width", F.posexplode("x.dwin").alias("i", "w")).where("w is not null")
    hits = dwin.join(asked, ["w", "width"]).select("row_key", "item_key", "width", "w", "k", (F.col("i") - F.col("k")).alias("d")).checkpoint()
    pair = ["row_key", "item_key"]
    met_windows = hits.select(*pair, "w").distinct().groupBy(*pair).agg(F.count("*").alias("n_matched")).join(total, "item_key")
    good = met_windows.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    ways = hits.groupBy(*pair, "d").agg(F.count("*").alias("n")).groupBy(*pair, "n").agg(F.collect_list("d").alias("ds"))
    at = ways.groupBy(*pair).agg(F.max_by("ds", "n").alias("ds")).join(good, pair, "left_semi").select(*pair, F.explode("ds").alias("d"))
    spots = hits.join(at, [*pair, "d"]).select(*pair, "d", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("width") - 1)).alias("p")).distinct()
    islots = items.select("item_key", F.posexplode(F.arrays_zip(F.col("ican").alias("c"), F.col("itok").alias("a"))).alias("p", "s")).select("item_key", "p", "s.c", "s.a").where(F.col("c").isin(NUMBER, UNIT, NAME)).dropDuplicates(["item_key", "p"])
    dslots = once.join(at.select("row_key").distinct(), "row_key", "left_semi").select("row_key", F.posexplode("dtok").alias("q", "b"))
    way = [*pair, "d"]
    slots = spots.join(islots, ["item_key", "p"]).withColumn("q", F.col("p") + F.col("d")).join(dslots, ["row_key", "q"]).groupBy(*way, "c", "a", "b").agg(F.count("*").alias("m"))
    values = slots.groupBy(*way, "c", "a").agg(F.count("*").alias("nb"), F.sum("m").alias("m"), F.max("m").alias("top"), F.every(F.col("a") == F.col("b")).alias("same"))
    shape = values.groupBy(*way).agg(F.sum("nb").alias("n_slots"), F.sum("m").alias("m"), F.sum("top").alias("top"), F.every("same").alias("same"))
    agrees = shape.where(F.col("top") >= F.col("m") * agreement).groupBy(*pair).agg(F.max(F.struct("same", (-F.col("d")).alias("e"), "n_slots")).alias("best"))
    # pairs whose alignments have no slot at all, or agree in one of them
    bare = at.join(shape.select(*way), way, "left_anti").select(*pair).distinct().withColumn("best", F.struct(F.lit(True).alias("same"), F.lit(0).alias("e"), F.lit(0).cast("long").alias("n_slots")))
    ok = agrees.unionByName(bare).groupBy(*pair).agg(F.max("best").alias("best")).select(*pair, "best.same", "best.n_slots")
    out = good.join(ok, pair)
    kind = F.when(F.col("same"), F.lit("exact")).otherwise(F.lit("template"))
    named = items.select("item_key", "item_id")
    return out.join(named, "item_key").join(found.select("row_key", "doc_id"), "row_key").select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"), "coverage", F.col("n_slots").cast("long").alias("n_slots"), kind.alias("kind"), "row_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a leak, with their columns."""
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("row_key").alias("__key"), F.col("doc_id").alias("__id")).distinct().checkpoint()
    if bad.count() <= BROADCAST_WINDOWS:
        bad = F.broadcast(bad)
    # a row is told by its id and by its hash, so hashes that meet by chance take no clean row with them
    return docs.join(bad, (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__key")) & docs[id_col].eqNullSafe(F.col("__id")), "left_anti")
