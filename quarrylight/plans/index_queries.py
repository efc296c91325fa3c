"""Planner, store, chunking, search, snippet and vector queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import tokens
from quarrylight.operators import chunking, planner, search, store
from quarrylight.sources.relations import load, text

NOW = 1_800_000_000_000
MOST = 64
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = text(sql)
        return f

    return put


_LATEST = """latest AS (SELECT path, arg_max(cache_key, last_updated) AS old, max(last_updated) AS saved_at FROM {catalog} GROUP BY path)"""
_CHANGES = f"""{_LATEST},
  cur AS (SELECT path, cache_key AS new, last_modified FROM {{files}} WHERE size <= 5242880 AND NOT (doc_id % 23 = 5)),
  changes AS (
    SELECT cur.path, new AS cache_key, 'add' AS kind FROM cur LEFT JOIN latest l ON l.path = cur.path WHERE l.path IS NULL OR (saved_at < last_modified AND old <> new)
    UNION ALL SELECT cur.path, new, 'touch' FROM cur JOIN latest l ON l.path = cur.path WHERE saved_at < last_modified AND old = new
    UNION ALL SELECT c.path, c.cache_key, 'remove' FROM {{catalog}} c WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.path = c.path)
    UNION ALL SELECT c.path, c.cache_key, 'remove' FROM {{catalog}} c JOIN cur ON cur.path = c.path JOIN latest l ON l.path = c.path
              WHERE saved_at < last_modified AND (old <> new OR c.cache_key <> new))"""
_OPS = f"""{_CHANGES},
  known AS (SELECT cache_key, count(*) AS tags FROM {{global_cache}} WHERE artifact_id = 'chunks' GROUP BY cache_key),
  ops AS (SELECT path, ch.cache_key, CASE WHEN kind = 'add' THEN CASE WHEN tags > 0 THEN 'addTag' ELSE 'compute' END ELSE CASE WHEN tags > 1 THEN 'removeTag' ELSE 'delete' END END AS op
          FROM changes ch LEFT JOIN known k ON k.cache_key = ch.cache_key WHERE kind <> 'touch')"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.diff(load(spark, sf_dir, "files").filter("NOT (doc_id % 23 = 5)"), load(spark, sf_dir, "catalog"))


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.ops(_changes(spark, sf_dir), load(spark, sf_dir, "global_cache"), "chunks")


@query("SELECT path, arg_max(cache_key, last_updated) AS cache_key, max(last_updated) AS last_updated, count(*) AS n_versions FROM {catalog} GROUP BY path")
def catalog_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.latest(load(spark, sf_dir, "catalog"))


@query(f"WITH {_CHANGES} SELECT path, cache_key, kind FROM changes")
def refresh_plan_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {_OPS} SELECT path, cache_key, op FROM ops")
def refresh_plan_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ops(spark, sf_dir)


@query(
    f"""WITH {_CHANGES} SELECT path, cache_key, last_updated FROM {{catalog}} c
    WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE x.path = c.path AND x.cache_key = c.cache_key)
    UNION ALL SELECT path, cache_key, {NOW} FROM changes WHERE kind <> 'remove'"""
)
def refresh_catalog_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.catalog_after(load(spark, sf_dir, "catalog"), _changes(spark, sf_dir), NOW)


@query(
    f"""WITH {_OPS}, side AS (SELECT cache_key, CASE WHEN op IN ('compute', 'addTag') THEN 'add' ELSE 'remove' END AS kind FROM ops)
    SELECT cache_key, dir, branch, artifact_id FROM {{global_cache}} g
    WHERE NOT (dir = 'src0' AND branch = 'en' AND artifact_id = 'chunks' AND EXISTS (SELECT 1 FROM side s WHERE kind = 'remove' AND s.cache_key = g.cache_key))
    UNION SELECT cache_key, 'src0', 'en', 'chunks' FROM side WHERE kind = 'add'"""
)
def refresh_cache_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.cache_after(load(spark, sf_dir, "global_cache"), _ops(spark, sf_dir), "src0", "en", "chunks")


@query(
    f"""WITH {_OPS}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY op ORDER BY substr(md5(path), 1, 2), path, cache_key) - 1) // 20 AS batch FROM ops)
    SELECT op, batch, count(*) AS n, min(path) AS first_path FROM numbered GROUP BY op, batch"""
)
def refresh_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.batches(_ops(spark, sf_dir), 20).groupBy("op", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query("SELECT t.tag, t.chunk_id FROM {doc_tags} t JOIN {doc_chunks} c ON c.id = t.chunk_id WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.path = c.path AND f.cache_key = c.cache_key AND f.doc_id % 6 = 0)")
def store_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files")
    _, _, tags = store.delete_files(files, load(spark, sf_dir, "doc_chunks"), load(spark, sf_dir, "doc_tags"), files.filter("doc_id % 6 = 0").select("path", "cache_key"))
    return tags.select("tag", "chunk_id")


@query("SELECT tag, chunk_id FROM {doc_tags} UNION SELECT 'new::main::chunks', id FROM {doc_chunks} WHERE cache_key IN (SELECT cache_key FROM {files} WHERE doc_id % 9 = 4)")
def store_add_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "files").filter("doc_id % 9 = 4")
    return store.add_tag(load(spark, sf_dir, "doc_tags"), load(spark, sf_dir, "doc_chunks"), items, "new::main::chunks")


@query(
    """SELECT tag, chunk_id FROM {doc_tags} t WHERE NOT (tag = 'src1::en::chunks' AND EXISTS
    (SELECT 1 FROM {doc_chunks} c JOIN {files} f ON f.path = c.path AND f.cache_key = c.cache_key WHERE c.id = t.chunk_id AND f.doc_id % 2 = 0))"""
)
def store_remove_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "files").filter("doc_id % 2 = 0").select("path", "cache_key")
    return store.remove_tag(load(spark, sf_dir, "doc_tags"), load(spark, sf_dir, "doc_chunks"), items, "src1::en::chunks")


@query("SELECT cache_key, branch, min(doc_id) AS id FROM {files} GROUP BY cache_key, branch")
def store_dedupe_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_least(load(spark, sf_dir, "files").withColumnRenamed("doc_id", "id"), ["cache_key", "branch"]).select("cache_key", "branch", "id")


@query("SELECT cache_key, count(*) AS n FROM {files} GROUP BY cache_key HAVING count(*) > 1")
def store_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.doubles(load(spark, sf_dir, "files"), ["cache_key"])


@query("SELECT cache_key, dir, min_by(doc_id, (path, doc_id)) AS first_id FROM {files} GROUP BY cache_key, dir")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(load(spark, sf_dir, "files"), ["cache_key", "dir"], ["path", "doc_id"]).select("cache_key", "dir", F.col("doc_id").alias("first_id"))


# ---------------------------------------------------------------- chunks

TOKEN_SQL = r"len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]'))"
_SPANS = rf"""
  l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM {{files}} WHERE regexp_matches(content, '[^\x20\x09-\x0D]')),
  t AS (SELECT *, {TOKEN_SQL.format("line")} AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
  st AS (
    SELECT DISTINCT doc_id, 0 AS place, 0 AS used, 0 AS start_line, false AS emit, 0 AS a, 0 AS b, n FROM t
    UNION ALL
    SELECT s.doc_id, place + 1, (CASE WHEN used + t > {MOST - 5} THEN 0 ELSE used END + CASE WHEN t < {MOST} THEN t + 1 ELSE 0 END)::INT,
           CASE WHEN used + t > {MOST - 5} THEN place ELSE start_line END, used + t > {MOST - 5}, start_line, place - 1, s.n
    FROM st s JOIN t ON t.doc_id = s.doc_id AND t.i = s.place),
  spans AS (SELECT doc_id, a, b FROM st WHERE emit UNION ALL SELECT doc_id, start_line, place - 1 FROM st WHERE place = n),
  chunks AS (
    SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY a, b) - 1 AS idx, a AS start_line, b AS end_line,
           coalesce((SELECT string_agg(line || chr(10), '' ORDER BY i) FROM t WHERE t.doc_id = s.doc_id AND t.i BETWEEN a AND b AND t.t < {MOST}), '') AS content FROM spans s)"""
_PIECES = f"""{_SPANS},
  pieces AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS piece_index, {TOKEN_SQL.format("content")} AS n_tokens FROM chunks WHERE {TOKEN_SQL.format("content")} <= {MOST})"""


@query(f"WITH RECURSIVE {_SPANS} SELECT doc_id, idx, start_line, end_line, content FROM chunks")
def chunk_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").select("doc_id", "path", "content")
    return chunking.basic_chunks(files, MOST).select("doc_id", "idx", "start_line", "end_line", "content")


@query(f"WITH RECURSIVE {_PIECES} SELECT doc_id, idx, piece_index, n_tokens FROM pieces")
def chunk_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").select("doc_id", "path", "content")
    return chunking.document_chunks(files, MOST).select("doc_id", "idx", "piece_index", tokens.count(F.col("content")).alias("n_tokens"))


@query(
    """SELECT id AS chunk_id, lag(id) OVER w AS prev_chunk, lead(id) OVER w AS next_chunk, count(*) OVER (PARTITION BY path) AS piece_count FROM {doc_chunks}
    WINDOW w AS (PARTITION BY path ORDER BY piece_index)"""
)
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.linked(load(spark, sf_dir, "doc_chunks"), "path").select(F.col("id").alias("chunk_id"), "prev_chunk", "next_chunk", "piece_count")


@query("SELECT (SELECT count(DISTINCT path) FROM {files}) AS files, (SELECT count(*) FROM {doc_chunks}) AS chunks")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").agg(F.countDistinct("path").alias("files"))
    return files.join(F.broadcast(load(spark, sf_dir, "doc_chunks").agg(F.count(F.lit(1)).alias("chunks"))))  # one row each


# ---------------------------------------------------------------- search

SEARCHES = {"one": "license", "two": "apache version", "three": "the and tion?", "short": "of", "path": "src1/en"[:4] + " doc_1"}


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "files").select(F.col("doc_id").alias("id"), "path", "content")


_TERMS = ", ".join(f"('{q}', {i}, '{p}')" for q, s in SEARCHES.items() for i, p in enumerate(search.phrases(s)))
#: None of these phrases overlaps itself, so removing them counts them.
_COUNT = lambda c: f"((length({c}) - length(replace(lower({c}), phrase, ''))) // length(phrase))"
_BM25 = f"""
  sized AS (SELECT doc_id AS id, path, content, greatest(length(path) - 2, 0) + greatest(length(content) - 2, 0) AS len FROM {{files}}),
  corpus AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM sized),
  terms(query, n, phrase) AS (VALUES {_TERMS}),
  hits AS (SELECT query, n, id, len, {_COUNT("path")} AS in_path, {_COUNT("content")} AS in_content FROM sized JOIN terms ON contains(lower(path), phrase) OR contains(lower(content), phrase)),
  freq AS (SELECT query, n, count(*) AS df FROM hits GROUP BY query, n),
  parts AS (SELECT h.query, id, greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) AS idf, 1.2 * (0.25 + 0.75 * len / avg_len) AS norm, in_path, in_content
            FROM hits h JOIN freq f ON f.query = h.query AND f.n = h.n CROSS JOIN corpus),
  scored AS (SELECT query, id, sum(-idf * (in_path + in_content) * 2.2 / (in_path + in_content + norm)) AS rank, sum(-idf * (20 * in_path + in_content) * 2.2 / (20 * in_path + in_content + norm)) AS weighted
             FROM parts p GROUP BY query, id HAVING count(*) = (SELECT count(*) FROM terms t WHERE t.query = p.query)),
  best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weighted, id) AS ord FROM scored QUALIFY ord <= 10)"""


@query(f"WITH {_BM25} SELECT query, id, ord, round(rank, 6) AS rank FROM best")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.bm25(_corpus(spark, sf_dir), SEARCHES), 10).select("query", "id", "ord", F.round("rank", 6).alias("rank"))


@query(f"WITH {_BM25} SELECT query, id, path, ord FROM best JOIN sized USING (id) WHERE rank <= -2.5")
def fts_bm25_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_corpus(spark, sf_dir), None, SEARCHES, 10).select("query", "id", "path", "ord")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    first = rows.orderBy("id").limit(1).collect()  # the query vector
    return rows, list(first[0]["vector"]) if first else [0.0]


_DISTANCE = "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) * (embedding[i]::DOUBLE - q[i]::DOUBLE))))"
_NEAR = f"q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings, q)"


@query(f"WITH {_NEAR} SELECT vec_id, round(greatest(0, least(1, 1 - distance * distance / 2)), 6) AS cos_sim FROM d ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return search.nearest(rows, q, 10).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("cos_sim"))


@query(f"WITH {_NEAR} SELECT label, vec_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) <= 3")
def vector_topk_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _vectors(spark, sf_dir)
    return search.nearest(rows, q, 3, tag="label").select("label", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, len(embedding) AS dim FROM embeddings")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    bare = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    as_text = F.when(F.col("vec_id") % 2 == 0, bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return rows.select("vec_id", F.size(search.parse_vector(as_text)).cast("long").alias("dim"))


@query(
    """SELECT title, tag, count(*) AS n FROM (SELECT DISTINCT path, cache_key, title, content, start_line, end_line, tag FROM {snippets} WHERE length(title) > 0 AND length(content) >= 10)
    GROUP BY title, tag"""
)
def snippets_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.usable_snippets(load(spark, sf_dir, "snippets"))
    table = store.upsert(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0"), search.SNIPPET_KEYS)
    table = store.upsert(table, rows.filter("id % 6 IN (1, 5)"), search.SNIPPET_KEYS)
    return table.groupBy("title", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT DISTINCT path FROM {snippets} WHERE starts_with(lower(path), 'src1') ORDER BY path LIMIT 25 OFFSET 5),
    s AS (SELECT DISTINCT path, signature FROM {snippets} WHERE path IN (SELECT path FROM p) ORDER BY path, signature LIMIT 20 OFFSET 2)
    SELECT path, string_agg(signature, '|' ORDER BY signature) AS signatures, (SELECT count(*) FROM s) = 20 AS has_more FROM s GROUP BY path"""
)
def snippets_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _, more = search.signatures_page(load(spark, sf_dir, "snippets"), ["SRC1"], 5, 25, 2, 20)
    return page.select("path", F.array_join("signatures", "|").alias("signatures"), F.lit(more).alias("has_more"))


@query(
    """SELECT id, title AS name, CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE path END AS description,
    concat('```', CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE path END, chr(10), content, chr(10), '```') AS content FROM {snippets}"""
)
def snippet_context_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.context_item(load(spark, sf_dir, "snippets"), ["src1"])
