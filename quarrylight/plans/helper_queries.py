"""Queries of helpers, scopes and broken links, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as fx
from quarrylight.functions import tokens, uris
from quarrylight.operators import lookup, rebuild, search
from quarrylight.plans.index_queries import TOKEN_SQL
from quarrylight.plans.lookup_queries import _matches_sql, asked
from quarrylight.plans.text_queries import _CLEAN, DIRS, _found_sql
from quarrylight.sources.relations import load, text
from quarrylight.streaming import watch

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, text(sql)
        return f

    return put


# ---------------------------------------------------------------- scopes and links

_PATHS = ["geo/ASIA.txt", "geo/EUROPE.txt"]
_IN_PATHS = "('geo/ASIA.txt', 'geo/EUROPE.txt')"


@query(f"WITH {_matches_sql(f'WHERE s.path IN {_IN_PATHS}')} SELECT query, match_kind, id, path, ord FROM matches")
def lookup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "symbol_chunks")
    symbols = lookup.in_scope(load(spark, sf_dir, "symbols"), chunks, load(spark, sf_dir, "symbol_tags"), None, _PATHS)
    return lookup.find_symbols(symbols, asked(spark), lookup.piece_counts(chunks)).select("query", "match_kind", "id", "path", "ord")


@query(
    f"""WITH RECURSIVE tree AS (SELECT id AS root, id, 0 AS depth, type IN ('file', 'class') AS grows FROM {{symbols}} WHERE type = 'file'
    UNION ALL SELECT t.root, s.id, t.depth + 1, t.grows FROM tree t JOIN {{symbols}} s ON s.parent_id = t.id WHERE t.grows AND s.path IN {_IN_PATHS}) SELECT root, id, depth FROM tree"""
)
def symbol_descendants_in_paths(spark, sf_dir):
    symbols = load(spark, sf_dir, "symbols")
    return rebuild.descendants(symbols, symbols.filter("type = 'file'").select("id"), _PATHS).select("root", "id", "depth")


#: Of the orders, one in three has links that run backwards, one in three has lost them, one in three has a cycle.
_BROKEN = """(SELECT id, symbol_id, piece_index, piece_count, idx, start_line, end_line, content, signature,
    CASE CAST(symbol_id AS BIGINT) % 3 WHEN 0 THEN next_chunk WHEN 1 THEN NULL ELSE coalesce(prev_chunk, next_chunk, id) END AS prev_chunk,
    CASE CAST(symbol_id AS BIGINT) % 3 WHEN 0 THEN prev_chunk WHEN 1 THEN NULL ELSE coalesce(next_chunk, prev_chunk, id) END AS next_chunk FROM {order_chunks})"""


@query(
    f"""SELECT symbol_id, CASE WHEN CAST(symbol_id AS BIGINT) % 3 = 0 THEN string_agg(content, '' ORDER BY piece_index DESC) ELSE string_agg(content, '' ORDER BY piece_index) END AS code,
    max(CASE WHEN piece_index = 0 THEN signature END) AS signature FROM {_BROKEN} b GROUP BY symbol_id"""
)
def symbol_rebuild_broken_links(spark, sf_dir):
    c, way = load(spark, sf_dir, "order_chunks"), F.col("symbol_id").cast("long") % 3
    before = F.when(way == 0, F.col("next_chunk")).when(way == 2, F.coalesce("prev_chunk", "next_chunk", "id"))
    after = F.when(way == 0, F.col("prev_chunk")).when(way == 2, F.coalesce("next_chunk", "prev_chunk", "id"))
    return rebuild.bodies(c.withColumns({"prev_chunk": before, "next_chunk": after})).select("symbol_id", "code", "signature")


_VECTORS = "(SELECT vec_id AS id, embedding, concat('dir', label % 3, '/', vec_id) AS path, concat('tag', label % 4) AS tag FROM embeddings)"
_DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - CASE i WHEN 1 THEN 1.0 ELSE 0.0 END) * (v.embedding[i]::DOUBLE - CASE i WHEN 1 THEN 1.0 ELSE 0.0 END))))"


@query(f"WITH d AS (SELECT id, tag, {_DISTANCE} AS distance FROM {_VECTORS} v WHERE starts_with(path, 'dir1/')) SELECT id, tag, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY tag ORDER BY distance, id) <= 300")
def vector_nearest_in_prefix(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("dir"), F.col("label") % 3, F.lit("/"), F.col("vec_id")).alias("path"), F.concat(F.lit("tag"), F.col("label") % 4).alias("tag"))
    return search.nearest(rows, [1.0] + [0.0] * 63, 10, "tag", "dir1/").select("id", "tag", F.round("distance", 6).alias("distance"))


@query(f"WITH d AS (SELECT id, {_DISTANCE} AS distance FROM {_VECTORS} v) SELECT id, round(distance, 6) AS distance, round(greatest(0, least(1, 1 - distance * distance / 2)), 6) AS similarity FROM d ORDER BY d.distance, id LIMIT 12")
def vector_nearest_overall(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("tag"), F.col("label") % 4).alias("tag"))
    twice = search.nearest(rows.union(rows.withColumn("tag", F.lit("all"))), [1.0] + [0.0] * 63, 12, "tag")
    return search.nearest_overall(twice, 12).select("id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("SELECT ts, concat('u/', user_id) AS path FROM events UNION ALL SELECT ts, concat('v/', user_id, '/', event_type) FROM events WHERE event_type = 'purchase'")
def watch_touched_paths(spark, sf_dir):
    """Purchases move a path, errors touch a hidden one beside it."""
    events = load(spark, sf_dir, "events")
    moves = events.select("ts", F.when(F.col("event_type") == "purchase", "moved").otherwise("modified").alias("kind"), F.concat(F.lit("u/"), F.col("user_id")).alias("src"), F.concat(F.lit("v/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("dest"))
    hidden = events.filter("event_type = 'error'").select("ts", F.lit("modified").alias("kind"), F.concat(F.lit("u/.cache/"), F.col("user_id")).alias("src"), F.lit(None).cast("string").alias("dest"))
    return watch.touched_paths(moves.union(hidden))


# ---------------------------------------------------------------- text and URIs


@query(r"SELECT doc_id, regexp_replace(concat('file:///r é/', lang, '+', source, '::main::', doc_id % 9, '.x_y-z'), '[^\pL\pN_.\-]', '', 'g') AS value FROM documents")
def vector_table_name(spark, sf_dir):
    tag = F.concat(F.lit("file:///r é/"), "lang", F.lit("+"), "source", F.lit("::main::"), F.col("doc_id") % 9, F.lit(".x_y-z"))
    return load(spark, sf_dir, "documents").select("doc_id", fx.table_name(tag).alias("value"))


@query("SELECT doc_id, sha256(CASE WHEN octet_length(encode(t)) <= 49900 THEN t ELSE right(t, 49900) END) AS value FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)")
def like_pattern(spark, sf_dir):
    """Over the ASCII characters of whole texts, so that bytes are characters; truncate_bytes cuts other characters."""
    ascii_ = F.regexp_replace("text", "[^ -~]", "")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(fx.like_pattern(ascii_), 256).alias("value"))


@query("SELECT doc_id, CASE WHEN n_words = 1 THEN 'word' ELSE 'words' END AS value FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ ]+')) AS n_words FROM documents)")
def plural_label(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", fx.plural(F.lit("word"), F.regexp_count("text", F.lit("[^ ]+"))).alias("value"))


_ARTIFACTS = ("chunks", "sqliteFts", "fullTextSearch", "codeSnippets", "vectordb::x", "embeddings", "other")


@query(
    f"""SELECT p_partkey, CASE WHEN a IN ('sqliteFts', 'fullTextSearch') THEN 'Full text search' WHEN a = 'chunks' THEN 'Chunking' WHEN a = 'codeSnippets' THEN 'Code snippets'
    WHEN starts_with(a, 'vectordb') OR starts_with(a, 'embeddings') THEN 'Embedding' ELSE a END AS value FROM (SELECT p_partkey, {list(_ARTIFACTS)!r}[p_partkey % {len(_ARTIFACTS)} + 1] AS a FROM part)"""
)
def index_label(spark, sf_dir):
    artifact = F.get(F.array(*[F.lit(a) for a in _ARTIFACTS]), (F.col("p_partkey") % len(_ARTIFACTS)).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", fx.index_name(artifact).alias("value"))


_MESSAGES = ("x Sqlite_Full y", "SQLITE_BUSY: wait", "sqlite_ioerr", "Invalid argument error: Values length 12 is less than the length (34) multiplied by the value size 5", "Values length 12", "no error")


@query(f"SELECT o_orderkey, [true, false, true, true, false, false][o_orderkey % {len(_MESSAGES)} + 1] AS value FROM orders")
def error_clears_index(spark, sf_dir):
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("o_orderkey") % len(_MESSAGES)).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", fx.clears_index(message).alias("value"))


_ENCODED = "replace(replace(replace(replace(replace(replace(replace(url_encode({}), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~')"
_OWN = "concat('/w é/', source, '/', lang, ':', doc_id, '+(a)~.txt')"


@query(f"SELECT doc_id, concat('file://', array_to_string([replace({_ENCODED.format('x')}, '%3A', ':') FOR x IN string_split({_OWN}, '/')], '/')) AS uri, {_OWN} AS path FROM documents")
def uri_of_path(spark, sf_dir):
    own = F.concat(F.lit("/w é/"), "source", F.lit("/"), "lang", F.lit(":"), "doc_id", F.lit("+(a)~.txt"))
    rows = load(spark, sf_dir, "documents").select("doc_id", uris.path_to_uri(own).alias("uri"))
    return rows.select("doc_id", "uri", uris.uri_to_path(F.col("uri")).alias("path"))


@query(f"SELECT doc_id, concat('file:///w/', array_to_string([{_ENCODED.format('x')} FOR x IN [source, 'é b', lang]], '/'), '/', doc_id, '%23.txt') AS value FROM documents")
def uri_join(spark, sf_dir):
    folder = F.concat(F.lit("\\"), "source", F.lit("\\é b/"), "lang", F.lit("/"))
    return load(spark, sf_dir, "documents").select("doc_id", uris.join_paths(F.lit("file:///w"), folder, F.concat(F.col("doc_id").cast("string"), F.lit("#.txt"))).alias("value"))


_BASE = f"url_decode(replace(split_part({_CLEAN}, '/', -1), '+', '%2B'))"


@query(
    f"""WITH f AS (SELECT page_id, url, {_found_sql("relative")} AS relative, {_found_sql("dir")} AS found_in, {_BASE} AS base FROM pages),
    p AS (SELECT *, regexp_split_to_array(relative, '[\\\\/]') AS parts FROM f)
    SELECT page_id, relative, found_in, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') AS last2, base, CASE WHEN contains(base, '.') THEN lower(split_part(base, '.', -1)) ELSE '' END AS extension FROM p"""
)
def uri_description(spark, sf_dir):
    d = uris.description(F.col("url"), DIRS)
    return load(spark, sf_dir, "pages").withColumn("d", d).select("page_id", F.col("d.relative_path_or_basename").alias("relative"), F.col("d.found_in_dir").alias("found_in"), F.col("d.last2_parts").alias("last2"), F.col("d.base_name").alias("base"), "d.extension")


# ---------------------------------------------------------------- tokens


@query("SELECT o_orderkey, CAST(floor(least(1000.0, o_totalprice::BIGINT * 0.02)) AS BIGINT) AS value FROM orders")
def token_buffer(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", tokens.buffer(F.round("o_totalprice").cast("long")).alias("value"))


_T = lambda c: TOKEN_SQL.format(c)


@query(
    f"""SELECT r_regionkey, CAST(24 + sum({_T("n_name")} + {_T("concat('About ', n_name, ', in ', r_name)")} + {_T("concat(n_name, '_key')")} + 2 + {_T("'integer'")}
      + {_T("'kind'")} + 2 + {_T("'one of these'")} + {_T("r_name")} + 3 + {_T("'x-y'")}) AS BIGINT) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def token_tool_schemas(spark, sf_dir):
    """A region's nations as tools, with a typed field and one of two values each."""
    kind = "array<struct<name:string,type:string,description:string,values:array<string>>>"
    none = F.lit(None).cast("string")
    fields = F.array(
        F.struct(F.concat("n_name", F.lit("_key")).alias("name"), F.lit("integer").alias("type"), none.alias("description"), F.lit(None).cast("array<string>").alias("values")),
        F.struct(F.lit("kind").alias("name"), none.alias("type"), F.lit("one of these").alias("description"), F.array(F.col("r_name"), F.lit("x-y")).alias("values")),
    ).cast(kind)
    tool = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("About "), "n_name", F.lit(", in "), "r_name").alias("description"), fields.alias("fields"))
    both = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_regionkey").agg(F.collect_list(tool).alias("tools")).select("r_regionkey", tokens.tool_schemas(F.col("tools")).alias("value"))


_PIECES = r"regexp_extract_all(text, '[\x20\x09-\x0D]*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D])[\x20\x09-\x0D]*')"


@query(f"SELECT doc_id, CASE WHEN len(p) <= 40 THEN text ELSE array_to_string(p[1:40], '') END AS first, CASE WHEN len(p) <= 40 THEN text ELSE array_to_string(p[len(p) - 39:], '') END AS last FROM (SELECT doc_id, text, {_PIECES} AS p FROM documents)")
def prune_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tokens.prune_text(F.col("text"), 40, False).alias("first"), tokens.prune_text(F.col("text"), 40, True).alias("last"))
