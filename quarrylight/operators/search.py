"""Trigram BM25 search, vector search and snippets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
PATH_WEIGHT, THRESHOLD = 20.0, -2.5
FILTERED_LIMIT = 300


def phrases(query: str) -> list[str]:
    """The phrases of a query: words by white space, question marks removed, those under three characters dropped."""
    words = query.replace("?", "").split()
    if any(not all(c.isalnum() or c == "_" or ord(c) > 127 for c in w) for w in words):
        raise ValueError(f"punctuation in a search query: {query!r}")
    return [w.lower() for w in words if len(w) >= 3]


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase occurs, overlaps counted."""
    return F.regexp_count(F.lower(text), F.concat(F.lit(r"(?=\Q"), phrase, F.lit(r"\E)")))


def bm25(chunks: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query, id, rank, weighted): plain and path-weighted scores of the chunks that hold all phrases; less is better.

    chunks: id, path, content, the whole corpus, over which sizes and frequencies are counted. A query whose phrases
    are all too short matches nothing.
    """
    spark = chunks.sparkSession
    terms = [(q, i, p) for q, text in queries.items() for i, p in enumerate(phrases(text))]
    asked = F.broadcast(spark.createDataFrame(terms or [("", 0, "")], "query string, n int, phrase string"))  # a stated set of queries
    need = asked.filter("phrase <> ''").groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    grams = lambda c: F.greatest(F.length(F.lower(c)) - 2, F.lit(0))
    sized = chunks.select("id", "path", "content", (grams(F.col("path")) + grams(F.col("content"))).alias("len"))
    corpus = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    low = lambda c: F.lower(F.col(c))
    hits = sized.join(asked.filter("phrase <> ''"), F.contains(low("path"), F.col("phrase")) | F.contains(low("content"), F.col("phrase")))
    hits = hits.select("query", "n", "phrase", "id", "len", occurrences(F.col("path"), F.col("phrase")).alias("in_path"), occurrences(F.col("content"), F.col("phrase")).alias("in_content"))
    freq = hits.groupBy("query", "n").agg(F.count(F.lit(1)).alias("df"))
    both = hits.join(F.broadcast(freq), ["query", "n"]).join(F.broadcast(corpus))  # as many rows as phrases; one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    score = lambda f: -idf * f * (K1 + 1) / (f + norm)
    scored = both.groupBy("query", "id").agg(F.count(F.lit(1)).alias("found"), F.sum(score(F.col("in_path") + F.col("in_content"))).alias("rank"), F.sum(score(PATH_WEIGHT * F.col("in_path") + F.col("in_content"))).alias("weighted"))
    return scored.join(F.broadcast(need), "query").filter("found = need").select("query", "id", "rank", "weighted")


def top(scored: DataFrame, n: float, by: str = "weighted", partition: str = "query") -> DataFrame:
    """The best ceil(n) of each query; ties by id."""
    w = Window.partitionBy(partition).orderBy(by, "id")
    return scored.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= math.ceil(n))


def search(chunks: DataFrame, chunk_tags: DataFrame | None, queries: dict[str, str], n: float, tags: list[str] | None = None, paths: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(query, id, path, rank, ord). The limit comes before the threshold on the plain rank, and doubles by tag count in it."""
    scored = bm25(chunks, queries)
    if paths is not None:
        scored = scored.join(chunks.filter(F.col("path").isin(paths)).select("id"), "id", "left_semi")
    if tags is not None:
        scored = scored.join(chunk_tags.filter(F.col("tag").isin(tags) if tags else F.lit(False)).select(F.col("chunk_id").alias("id")), "id")
    best = top(scored, n).filter(F.col("rank") <= threshold)
    first = best.groupBy("query", "id").agg(F.min("ord").alias("ord"), F.min("rank").alias("rank"))
    return first.join(chunks.select("id", "path"), "id").select("query", "id", "path", "rank", "ord")


# ---------------------------------------------------------------- vectors


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def similarity(d: Column) -> Column:
    """Cosine of unit vectors at this distance, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def parse_vector(c: Column) -> Column:
    """A vector from a JSON list, or from its numbers alone."""
    return F.coalesce(F.from_json(c, "array<double>"), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<double>"))


def nearest(vectors: DataFrame, query: list[float], n: int, tag: str | None = None, prefix: str | None = None, key: str = "id") -> DataFrame:
    """(key, [tag,] distance, similarity) of the n nearest, in each tag if there is a tag column, then overall by the caller.

    With a path prefix the 300 nearest of it are looked at first, as without an index on paths.
    """
    rows = vectors if prefix is None else vectors.filter(F.col("path").startswith(prefix))
    near = rows.withColumn("distance", distance(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])))
    if tag is None:
        out = near.orderBy("distance", key).limit(n)
    else:
        out = near.withColumn("_n", F.row_number().over(Window.partitionBy(tag).orderBy("distance", key))).filter(F.col("_n") <= (n if prefix is None else FILTERED_LIMIT)).drop("_n")
    return out.withColumn("similarity", similarity(F.col("distance")))


def nearest_overall(per_tag: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n nearest of all tags; a vector under several tags counts once."""
    once = per_tag.groupBy(key).agg(F.min("distance").alias("distance"))
    return once.orderBy("distance", key).limit(n).withColumn("similarity", similarity(F.col("distance")))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding provider: hashed words, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("i"), F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(slots, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(0.0))


# ---------------------------------------------------------------- snippets

SNIPPET_KEYS = ["path", "cache_key", "title", "content", "start_line", "end_line"]
LEAST_SNIPPET = 10


def usable_snippets(snippets: DataFrame) -> DataFrame:
    return snippets.filter((F.length("title") > 0) & (F.length("content") >= LEAST_SNIPPET))


def signatures_page(snippets: DataFrame, dirs: list[str], uri_offset: int, uri_batch: int, snippet_offset: int, snippet_batch: int) -> tuple[DataFrame, bool, bool]:
    """(path, signatures) of a page of paths and of a page of their distinct signatures, and whether there are more of each.

    Directories are ASCII case-insensitive prefixes.
    """
    inside = F.lit(False)
    for d in dirs:
        inside = inside | F.lower(F.col("path")).startswith(d.lower())
    paths = snippets.filter(inside).select("path").distinct().orderBy("path").offset(uri_offset).limit(uri_batch)
    found = snippets.join(paths, "path", "left_semi").select("path", "signature").distinct().orderBy("path", "signature").offset(snippet_offset).limit(snippet_batch)
    more_paths, more = paths.count() == uri_batch, found.count() == snippet_batch
    return found.groupBy("path").agg(F.sort_array(F.collect_list("signature")).alias("signatures")), more_paths, more


def context_item(snippets: DataFrame, dirs: list[str]) -> DataFrame:
    """(id, name, description, content): a snippet as fenced text under its path relative to its directory."""
    rel = F.col("path")
    for d in reversed(dirs):
        rel = F.when(F.col("path").startswith(d + "/"), F.substring(F.col("path"), F.lit(len(d) + 2), F.length("path"))).otherwise(rel)
    return snippets.select("id", F.col("title").alias("name"), rel.alias("description"), F.concat(F.lit("```"), rel, F.lit("\n"), F.col("content"), F.lit("\n```")).alias("content"))
