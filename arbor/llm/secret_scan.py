"""Secret scan with character Markov models, in DataFrame functions only.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A candidate token is a run of 16 or more of `A-Za-z0-9+/_=-`; its mean log-likelihood
ratio over its character pairs decides. The fixed patterns (base spans) always stay; a token is added
when no base span overlaps it.

Training. `samples` has (text, label, n): label 1 for random strings, 0 for ordinary identifiers, n the number of times.
`default_samples` makes random strings of known alphabets from hashes; ordinary are the words of all
documents, counted once, as they stand in identifiers (upper case, between signs, before numbers, two in a row). Words
that touch digits or underscores, such as most parts of secrets, are left out. What is gathered grows with the input; the model has
66 x 66 entries whatever the input, so it is small enough to be a constant of the plan.

Rules. Null and empty texts have no spans. Positions are code points, ends exclusive. Extra columns, also
such as `spans`, are dropped by `scan` and kept by `redact`, which takes the spans of `scan` and writes one mark for those that overlap or touch. Null
ids are ids like others. Repeated rows give repeated results; an empty table gives an empty result. One pass over the
rows, no shuffle, so no key can be hot; work grows linearly with a text, its matches and the length of a token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns: (kind, pattern, group whose length counts, least length), in the order of the contract.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A cheap test that all texts with a match of a kind pass.
HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
_TOKEN_CHARS = "A-Za-z0-9+/_=-"
#: A whole run: looking behind keeps the search from trying every place inside a word.
TOKEN = f"(?<![{_TOKEN_CHARS}])[{_TOKEN_CHARS}]{{16,}}"
#: One pass over a text that tells whether it has anything to look at; most texts have not.
GATE = "|".join([*HINT.values(), TOKEN])
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Ordinary words: letters beside no digit and no underscore.
WORD = r"\b[A-Za-z]{3,64}\b"
THRESHOLD = 0.7
#: Stands for each character of a span found before; texts that have it themselves keep it.
MASK = "\ue000"
#: A token of a masked text may have masked characters.
_MASKED_TOKEN = f"(?<![{MASK}{_TOKEN_CHARS}])[{MASK}{_TOKEN_CHARS}]{{16,}}"
_CHUNK = 128


def _let(value: Column, f) -> Column:
    """f(value) with value evaluated once, as the optimizer does not look into lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _steps(x: Column, start: Column, add) -> Column:
    """start, then what adding the first 1, 2, ... numbers to it gives."""
    return F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(add(F.get(acc, F.size(acc) - 1), v))))


def running(x: Column, add=lambda a, v: a + v) -> Column:
    """Running sums (or maxima of numbers from 0 on) of an array of ints. Arrays only grow inside chunks and over chunks, so long ones stay cheap."""

    def sums(x):
        chunks = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(_CHUNK)), lambda i: F.slice(x, i, _CHUNK))).otherwise(F.array(x))
        starts = lambda c: _steps(F.transform(c, lambda one: F.aggregate(one, F.lit(0), add)), F.lit(0), add)
        return _let(chunks, lambda c: F.flatten(F.zip_with(c, F.slice(starts(c), 1, F.size(c)), lambda one, s: F.slice(_steps(one, s, add), 2, _CHUNK))))

    return _let(x, sums)


def _matches(text: Column, pattern: str, group: int, f) -> Column:
    """f of the matches of a pattern; found: their texts; own: lengths of a group of each; parts: what stands between them. All see the same matches.

    text is used more than once and should be a column, not an expression.
    """
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if group:
        own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        return _let(F.struct(found.alias("found"), own.alias("own"), parts.alias("parts")), f)
    return _let(found, lambda t: _let(F.struct(t.alias("found"), F.transform(t, F.length).alias("own"), parts.alias("parts")), f))


_SPANS = "array<struct<start:int,end:int,kind:string,text:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, kind, text) of one pattern."""

    def place(m):
        ends = running(F.transform(m["found"], lambda t, i: F.length(F.get(m["parts"], i)) + F.length(t)))
        one = lambda e, i: F.struct((e - F.length(F.get(m["found"], i))).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), F.get(m["found"], i).alias("text"), F.get(m["own"], i).alias("own"))
        long = F.filter(F.transform(ends, one), lambda s: s["own"] >= least)
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))

    return F.when(text.rlike(HINT.get(kind, pattern)), _matches(text, pattern, group, place)).otherwise(F.array().cast(_SPANS))


def _masked(text: Column, pattern: str, group: int, hide, hint: str) -> Column:
    """The text with every character of the matches for which hide(match, length of its group) holds replaced by MASK."""

    def cover(m):
        put = lambda i: F.when(hide(F.get(m["found"], i), F.get(m["own"], i)), F.repeat(F.lit(MASK), F.length(F.get(m["found"], i)))).otherwise(F.get(m["found"], i))
        return F.array_join(F.transform(m["parts"], lambda p, i: F.concat(p, F.when(i < F.size(m["found"]), put(i)).otherwise(F.lit("")))), "")

    return F.when(text.rlike(hint), _matches(text, pattern, group, cover)).otherwise(text)


def _without_base(df: DataFrame, text: str, when: str) -> DataFrame:
    """Masks base spans of a text column, one pattern a step, where the condition holds; what one pattern masked, and the rest of its run, no later one needs."""
    for kind, pattern, group, least in BASE:
        df = df.withColumn(text, F.when(F.col(when), _masked(F.col(text), pattern, group, lambda found, own, least=least: own >= least, HINT[kind])).otherwise(F.col(text)))
    return df


def _row(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def random_strings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, label 1, n 1): strings of four alphabets."""
    seed = spark.range(0, n, 1, 1).select(F.sha2(F.col("id").cast("string"), 512).alias("x"))
    b64 = F.base64(F.unhex("x"))
    kinds = [F.substring(b64, 1, 40), F.translate(F.substring(b64, 41, 40), "+/", "-_"), F.upper(F.regexp_replace(F.substring(b64, 1, 86), "[+/=]", "")), F.substring("x", 1, 40)]
    return seed.select(F.explode(F.array(*kinds)).alias("text"), F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))


def default_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled strings with numbers of times: random strings, and the words of all documents as identifiers hold them."""
    spark = docs.sparkSession
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("w"))
    w, first, last = F.col("w"), F.substring("w", 1, 1), F.substring("w", -1, 1)
    form = lambda text, times: F.struct(text.alias("text"), (F.col("n") * times).alias("n"))
    # what a form shares with the word itself is in the word's weight
    joints = [F.concat(F.lit(s), first) for s in "_-"] + [F.concat(last, F.lit(s)) for s in "_-2"] + [F.concat(last, F.upper(first))]
    forms = [form(w, 6), form(F.upper("w"), 1), *[form(j, 1) for j in joints]]
    ordinary = found.groupBy("w").agg(F.count("*").alias("n")).select(F.explode(F.array(*forms)).alias("f")).select("f.text", F.lit(0).alias("label"), "f.n")
    digits = spark.range(0, 3000, 1, 1).select(F.regexp_replace(F.sha2(F.col("id").cast("string"), 512), "[a-f]", "").alias("text"), F.lit(0).alias("label"), F.lit(1).cast("long").alias("n"))
    return random_strings(spark).unionByName(ordinary).unionByName(digits)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, add-one smoothed, in row order of (ALPHABET + other)^2; n is 1 where there is no such column."""
    n = len(ALPHABET) + 1
    times = F.coalesce(F.col("n"), F.lit(1)) if "n" in samples.columns else F.lit(1)
    clean = samples.select("label", F.regexp_replace("text", f"[^{ALPHABET}]", " ").alias("text"), times.cast("long").alias("n")).where("label is not null and length(text) > 1")
    pairs = clean.select("label", "n", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i")).select("label", "n", F.substring("text", F.col("i"), F.lit(2)).alias("p"))
    counts = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "p").agg(F.sum("n").alias("n")).collect():  # at most 2 (n + 1)^2 rows
        counts[r.label][tuple(ALPHABET.find(c) + 1 for c in r.p)] = r.n
    out = []
    for a in range(n):
        totals = {k: sum(counts[k].get((a, b), 0) for b in range(n)) for k in counts}
        out += [round(math.log((counts[1].get((a, b), 0) + 1) / (totals[1] + n)) - math.log((counts[0].get((a, b), 0) + 1) / (totals[0] + n)), 4) for b in range(n)]
    return out


def llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a constant once
    total = lambda k: F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(k, i - 1) * n + F.get(k, i))) / (F.size(k) - 1)
    return _let(F.transform(F.split(token, ""), _row), total)


def with_spans(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD, out: str = "found") -> DataFrame:
    """Adds `out`: array of (start, end, kind, text) of base spans and added tokens, by start, kind, end."""
    none = F.array().cast(_SPANS)
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__some", F.col("__text").rlike(GATE))
    df = df.withColumn("__base", F.when(F.col("__some"), F.concat(*[_spans(F.col("__text"), *b) for b in BASE])).otherwise(none))
    # a character of the text that looks like the mask matches no pattern either
    df = df.withColumn("__text", F.when(F.col("__some"), F.replace("__text", F.lit(MASK), F.lit("\ue001")))).withColumn("__has", F.size("__base") > 0)
    df = _without_base(df, "__text", "__has")
    df = df.withColumn("__tokens", F.when(F.col("__some"), _spans(F.col("__text"), "markov", _MASKED_TOKEN, 0, 16)).otherwise(none))
    added = F.filter("__tokens", lambda t: ~F.contains(t["text"], F.lit(MASK)) & (llr(t["text"], model) > threshold))
    order = F.array(*[F.lit(b[0]) for b in BASE], F.lit("markov"))
    sort = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))
    both = F.array_sort(F.transform(F.concat("__base", added), sort))
    return df.withColumn(out, F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))).drop("__text", "__some", "__has", "__base", "__tokens")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_markov."""
    df = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", threshold)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), count("markov").alias("n_markov"),
    )


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text given as pieces of _CHUNK characters; costs no more than what it returns and two pieces."""
    i, j = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
    last = F.coalesce(F.substring(F.get(pieces, j), F.lit(1), b % _CHUNK), F.lit(""))
    within = F.coalesce(F.substring(F.get(pieces, i), a % _CHUNK + 1, b - a), F.lit(""))
    far = F.concat(F.substring(F.get(pieces, i), a % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), last)
    return F.when(i == j, within).otherwise(far)


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with one mark for every stretch that its spans (sorted by start) cover."""

    def whole(x):
        start = lambda i: F.get(x["spans"], i)["start"]
        before = lambda i: F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(F.lit(0))
        opens = F.filter(F.sequence(F.lit(0), F.size(x["spans"]) - 1), lambda i: (i == 0) | (start(i) > before(i)))
        kept = F.transform(opens, lambda i: F.concat(_cut(x["pieces"], before(i), start(i)), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _cut(x["pieces"], F.get(x["upto"], F.size(x["upto"]) - 1), x["size"]))

    upto = running(F.transform(spans, lambda s: s["end"]), lambda a, v: F.greatest(a, v))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return _let(F.struct(spans.alias("spans"), upto.alias("upto"), pieces.alias("pieces"), F.length(text).alias("size")), whole)


def redact(docs: DataFrame, model: list[float], *, text_col: str = "text", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The same columns, with `mark` for what the spans of the text cover; spans that overlap or touch have one mark.

    All spans are those of `with_spans`, so what `scan` reports is gone whole, also where one span begins inside another.
    """
    some = with_spans(docs, model, text_col, threshold, "__spans")
    return some.withColumn(text_col, F.when(F.size("__spans") > 0, _without(F.col(text_col), F.col("__spans"), mark)).otherwise(F.col(text_col))).select(*docs.columns)


def default_model(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> list[float]:
    return train(default_samples(docs, text_col))
