"""The catalog of documents, filters by name, node changes, vectors, logs and result formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import coords as K
from arbor.operators.retrieval import unit


class UnsupportedFilterError(ValueError):
    """A filter that has no translation."""


_FILTERS = {
    "document_id": lambda v: F.col("document_id") == v,
    "span_end_lt": lambda v: F.col("span_end") < v,
    "span_overlaps": lambda v: (F.col("span_start") < v[1]) & (F.col("span_end") > v[0]),
}


def translate(filters: dict) -> Column:
    """A conjunction of named filters as one Column; unknown names raise."""
    unknown = sorted(set(filters) - set(_FILTERS))
    if unknown:
        raise UnsupportedFilterError(", ".join(unknown))
    return reduce(Column.__and__, [_FILTERS[k](v) for k, v in filters.items()], F.lit(True))


def scoped(df: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the documents asked for only, whatever an index returned."""
    return df.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def find_documents(catalog: DataFrame, *, ids: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Documents of a catalog by ids, by the start of their path, or all."""
    out = catalog if ids is None else catalog.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    return out if prefix is None else out.where(F.col("path").startswith(prefix))


def set_temporal(catalog: DataFrame, flags: DataFrame) -> DataFrame:
    """The catalog with is_temporal as flags say; a flag of an absent document raises."""
    absent = flags.join(catalog, "document_id", "left_anti").limit(1).count()
    if absent:
        raise KeyError("a document to flag is not in the catalog")
    new = flags.select("document_id", F.col("is_temporal").alias("__new"))
    return catalog.join(new, "document_id", "left").withColumn("is_temporal", F.coalesce("__new", "is_temporal")).drop("__new")


def insert(nodes: DataFrame, batch: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The table with a batch of new rows, and the batch itself if it has under `most` rows, else none; an id in use raises."""
    if batch.join(nodes.select("id"), "id", "left_semi").limit(1).count():
        raise ValueError("an id is in use")
    small = batch.limit(most).count() < most
    return nodes.unionByName(batch), batch if small else batch.limit(0)


def set_fields(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of changes that are not null replace those of the row with their id."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    out = nodes.join(new, "id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"__{c}", c) if c in nodes.columns else F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in fields])


def upsert_vectors(index: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, vec) with the rows of changes in place of those with their id; vectors of changes are normalised, zero vectors raise."""
    new = changes.select("id", unit(F.col("vec")).alias("vec"))
    return index.select("id", "vec").join(new.select("id"), "id", "left_anti").unionByName(new)


def vectors_of(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of (query_id, ids) in the order of ids; ids without a vector are left out."""
    asked = wanted.select("query_id", F.posexplode("ids").alias("position", "id"))
    w = Window.partitionBy("query_id").orderBy("position")
    return asked.join(vectors.select("id", "vec"), "id").withColumn("position", F.row_number().over(w))


def query_log(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (query_id, document_id, n_nodes, tokens) and details (query_id, position, node_id) of tilings; a query without tiles raises.

    tiles: query_id, document_id, id, span_start, token_count; id is null where a query has no tile.
    """
    counted = tiles.groupBy("query_id", "document_id").agg(F.count("id").alias("n_nodes"), F.sum("token_count").alias("tokens"))
    header = counted.withColumn("n_nodes", F.when(F.col("n_nodes") > 0, F.col("n_nodes")).otherwise(F.raise_error(F.lit("empty tiling")).cast("bigint")))
    w = Window.partitionBy("query_id").orderBy("span_start", "id")
    detail = tiles.where("id is not null").select("query_id", (F.row_number().over(w) - 1).alias("position"), F.col("id").alias("node_id"))
    return header, detail


def result_json(tiles: DataFrame) -> DataFrame:
    """One JSON document a query: its tiles in order with coordinates and sizes."""
    node = F.struct("span_start", "id", "height", "level_index", "span_end", "token_count")
    a = F.array_sort(F.collect_list(node))
    out = F.transform(a, lambda x: F.struct(x["id"].alias("id"), x["height"].alias("height"), x["level_index"].alias("level_index"), x["span_start"].alias("span_start"), x["span_end"].alias("span_end"), x["token_count"].alias("token_count")))
    return tiles.groupBy("query_id").agg(F.to_json(F.struct(F.col("query_id"), out.alias("nodes"))).alias("json"))


def span_marks(nodes: DataFrame) -> DataFrame:
    """Head line of each node's text: its span, height and the tokens it stands for."""
    verbatim = (F.col("token_count") * F.pow(F.lit(2.0), F.col("height"))).cast("bigint")
    head = F.concat(F.lit("["), F.col("span_start").cast("string"), F.lit("-"), F.col("span_end").cast("string"), F.lit(" h="), F.col("height").cast("string"), F.lit(" verbatim="), verbatim.cast("string"), F.lit("]"))
    return nodes.select("id", verbatim.alias("verbatim_tokens"), head.alias("mark"))


def navigate(nodes: DataFrame, offset: int = 1) -> DataFrame:
    """Ids of each node's parent, children, sibling and neighbour at an offset that exist, by coordinates; one join a kind, on the same keys."""
    h, li = F.col("height"), F.col("level_index")
    to = {"parent": K.parent(h, li), "left": K.left_child(h, li), "right": K.right_child(h, li), "sibling": (h, K.sibling(li)), "neighbor": (h, K.neighbor(li, offset))}
    kinds = [F.struct(F.lit(k).alias("kind"), a.cast("int").alias("th"), b.cast("bigint").alias("tl")) for k, (a, b) in to.items()]
    asked = nodes.select("document_id", F.col("id").alias("source"), F.explode(F.array(*kinds)).alias("t")).select("document_id", "source", "t.*").where("th is not null and tl is not null")
    there = nodes.select("document_id", F.col("height").alias("th"), F.col("level_index").alias("tl"), "id")
    return asked.join(there, ["document_id", "th", "tl"]).groupBy("source").agg(*[F.max(F.when(F.col("kind") == k, F.col("id"))).alias(k) for k in to])


def descendants(nodes: DataFrame, depth: int) -> DataFrame:
    """(source, id) of the descendants down to a depth: an explode over heights and offsets, no join."""
    h, li = F.col("height"), F.col("level_index")
    down = nodes.where("height > 0").select("document_id", F.col("id").alias("source"), "height", "level_index", F.explode(F.sequence(F.lit(1), F.least(h, F.lit(depth)))).alias("d"))
    width = F.pow(F.lit(2.0), F.col("d")).cast("bigint")
    each = down.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), width - 1)))
    return each.select("source", K.node_id(F.col("document_id"), h - F.col("d"), li * width + F.col("k")).alias("id"))


def walk(leaves: DataFrame, steps: int) -> DataFrame:
    """(source, step, id): up to `steps` neighbours to the right of each leaf."""
    last = Window.partitionBy("document_id")
    x = leaves.withColumn("last", F.max("level_index").over(last)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = F.col("level_index") + F.col("step")
    return x.where(at <= F.col("last")).select(F.col("id").alias("source"), "step", K.node_id(F.col("document_id"), F.col("height"), at).alias("id"))


def qa_sessions(samples: DataFrame, json_col: str) -> DataFrame:
    """(sample_id, session, position, text) of objects with lists under session_N keys, sessions in numeric order."""
    m = samples.select("sample_id", F.explode(F.from_json(json_col, "map<string,array<string>>")).alias("key", "texts"))
    m = m.withColumn("session", F.regexp_extract("key", r"^session_(\d+)$", 1)).where("session <> ''")
    return m.select("sample_id", F.col("session").cast("bigint").alias("session"), F.posexplode("texts").alias("position", "text"))


def messages(records: DataFrame, json_col: str) -> DataFrame:
    """Adds role and text from three shapes of a transcript line.

    {"type": role, "message": {"content": text}}, {"role": role, "content": [{"type": "text", "text": text}, ...]} and
    {"message": {"role": role, "content": text}}; parts of other types than text are left out.
    """
    get = lambda p: F.get_json_object(json_col, p)
    parts = F.from_json(get("$.content"), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    role = F.coalesce(get("$.message.role"), get("$.role"), get("$.type"))
    return records.withColumn("role", role).withColumn("text", F.coalesce(get("$.message.content"), listed))


def included(records: DataFrame) -> DataFrame:
    """Records that are indexed: of a user or assistant, with a time, neither a summary nor a note."""
    return records.where(F.col("type").isin("user", "assistant") & ~F.col("is_compact") & ~F.col("is_meta") & F.col("ts").isNotNull())


def jobs(nodes: DataFrame, first: int) -> DataFrame:
    """The first jobs of each document in order of their span: leaves to embed and pairs of roots to join."""
    leaf = nodes.where("height = 0").select("document_id", "span_start", F.lit("embed").alias("kind"), "id")
    right = nodes.where("parent_id is null").select("document_id", "height", (F.col("level_index") - 1).alias("level_index"))
    pair = nodes.where("parent_id is null and level_index % 2 = 0").join(right, ["document_id", "height", "level_index"], "left_semi")
    both = leaf.unionByName(pair.select("document_id", "span_start", F.lit("summarise").alias("kind"), "id"))
    w = Window.partitionBy("document_id").orderBy("span_start", "kind", "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)


def glob_files(spark, folder: str, pattern: str = "*") -> DataFrame:
    """path, name and bytes of files, without their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))


def matched_runs(baseline: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """Files of two folders by name: in both, or only in one."""
    a, b = (x.select(key).distinct().withColumn(c, F.lit(True)) for x, c in ((baseline, "in_baseline"), (current, "in_current")))
    return a.join(b, key, "full").fillna(False, ["in_baseline", "in_current"])




def fenced_json(text: Column) -> Column:
    """The JSON inside a fenced block, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(F.contains(text, F.lit("```")), inner).otherwise(text))


def verdict(answer: Column) -> Column:
    """A, B or C of a judge's answer in JSON, fenced or bare; null if it has none."""
    found = F.upper(F.trim(F.get_json_object(fenced_json(answer), "$.verdict")))
    bare = F.upper(F.regexp_extract(answer, r"(?i)\bverdict\W+([abc])\b", 1))
    return F.when(found.isin("A", "B", "C"), found).when(bare != "", bare)


def truthy(c: Column) -> Column:
    """Lenient booleans: true, yes, 1, on and their opposites; null for anything else."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "yes", "1", "on"), True).when(low.isin("false", "no", "0", "off", ""), False)
