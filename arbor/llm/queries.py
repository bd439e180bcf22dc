"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.shared import ensure_checkpoint_dir, table


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.substring_dedup import substring_dedup

    ensure_checkpoint_dir(spark)
    out = substring_dedup(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("text").alias("kept_sha256"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.perspectives import rotate

    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "segment", "n_turns", "n_own", "start", "text", mask.alias("mask"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(CAST(floor(turn / 1024.0) AS BIGINT), -1) AS segment,
         replace(coalesce(text, ''), '<|', '<||') || '<|end|>' AS body
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT t.conv_id, p.perspective, t.segment, t.turn, t.role, t.text, body, coalesce(role = perspective, false) AS own,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || replace(coalesce(role, 'unknown'), '<|', '<||') || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective
            ORDER BY segment, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r)
SELECT conv_id, perspective, segment, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       CAST(min(pos) AS BIGINT) AS start,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT), ','
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, segment
"""


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.feistel_shard import shard_rows

    out = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.secret_scan import default_model, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, default_model(spark, docs))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.jaccard_join import jaccard_components

    ensure_checkpoint_dir(spark)
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90).drop("class_key")


def tokenizer_path() -> str:
    """The word-level BPE file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.bpe_tree import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)
    return out.select("doc_id", "n_tokens", F.decode("ids", "utf-8").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.neighbour_quality import fit, scores

    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.metric_join import near_duplicates

    ensure_checkpoint_dir(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.template_leaks import leaks

    ensure_checkpoint_dir(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.line_dedup import apply_bitmaps, line_bitmaps

    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, line_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
g AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, g.owner IS NOT NULL AND k.doc_id <> g.owner AS gone FROM k LEFT JOIN g USING (key))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY r
"""


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.wavelet_search import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, * FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
c AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N_ + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term, N_),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_) // L_)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbor.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, unnest(w) AS phrase, 1 AS words FROM p
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM p
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM p),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= 10),
k AS (
  SELECT lang, words, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, words, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM c WHERE words = 3),
s AS (
  SELECT k.lang, k.words, k.phrase, a, l.f AS l, r.f AS r, k,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS part, a FROM c WHERE words = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN e ON e.lang = b.lang AND e.part = b.phrase
WHERE e.a IS NULL OR 100 * e.a < 50 * b.a QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_markov_secrets": op4_markov_secrets,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_host_suffix_array": op6_host_suffix_array,
    "op7_template_leaks": op7_template_leaks,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_neighbour_quality": op9_neighbour_quality,
    "op10_metric_join": op10_metric_join,
    "op11_line_bitmaps": op11_line_bitmaps,
    "op12_wavelet_search": op12_wavelet_search,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op1_perspective_rotation": OP1_SQL,
    "op11_line_bitmaps": OP11_SQL,
    "op12_wavelet_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
