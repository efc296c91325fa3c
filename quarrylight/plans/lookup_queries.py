"""Lookup and rebuild queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import lookup, rebuild
from quarrylight.sources.relations import TAG, load, text

NAMES = ("NATION_7", "nation_3", "ation_1", "amer", "Supplier#000000007", "CUSTOMER#000000011", "AsIa", "no such name", "")
#: SQL that folds ASCII letters only.
_FOLD = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASKED = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS query)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "query string")


def _matches(spark: SparkSession, sf_dir: str, tags: list[str] | None) -> DataFrame:
    chunks = load(spark, sf_dir, "symbol_chunks")
    symbols = lookup.in_scope(load(spark, sf_dir, "symbols"), chunks, load(spark, sf_dir, "symbol_tags"), tags)
    return lookup.find_symbols(symbols, asked(spark), lookup.piece_counts(chunks))


def _matches_sql(scope: str) -> str:
    return f"""
    pieces AS (SELECT symbol_id, count(*) AS pieces FROM {{symbol_chunks}} GROUP BY symbol_id),
    found AS (
      SELECT q.query, s.*, CASE WHEN s.name = q.query THEN 1 WHEN {_FOLD("s.name")} = {_FOLD("q.query")} THEN 2 ELSE 3 END AS tier, coalesce(p.pieces, 0) AS pieces
      FROM {{symbols}} s JOIN {_ASKED} q ON contains({_FOLD("s.name")}, {_FOLD("q.query")}) AND length(q.query) > 0
      LEFT JOIN pieces p ON p.symbol_id = s.id {scope}),
    best AS (SELECT * FROM found QUALIFY tier = min(tier) OVER (PARTITION BY query)),
    once AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query, path, start_line, end_line, pieces ORDER BY path, start_line, end_line, type, name, id) = 1),
    matches AS (SELECT *, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'exact_case_insensitive' ELSE 'substring' END AS match_kind,
                row_number() OVER (PARTITION BY query ORDER BY path, start_line, end_line, type, name, id) AS ord FROM once)"""


_IN_SCOPE = f"WHERE EXISTS (SELECT 1 FROM {{symbol_chunks}} c JOIN {{symbol_tags}} t ON t.chunk_id = c.id WHERE c.cache_key = s.cache_key AND c.path = s.path AND t.tag = '{TAG}')"


def lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, None).select("query", "match_kind", "id", "path", "ord")


def lookup_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, [TAG]).select("query", "match_kind", "id", "pieces")


def lookup_auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.select(_matches(spark, sf_dir, [TAG]), asked(spark))


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r:1",), ("n:7",), ("s:3",)], "id string")


def symbol_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.descendants(load(spark, sf_dir, "symbols"), _roots(spark)).select("root", "id", "depth")


def symbol_rebuild_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.bodies(load(spark, sf_dir, "order_chunks")).select("symbol_id", "code", "signature")


def symbol_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = load(spark, sf_dir, "symbols")
    return rebuild.signature_tree(symbols, symbols.select(F.col("id").alias("symbol_id"), "signature"), _roots(spark))


def symbol_max_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rebuild.bodies(load(spark, sf_dir, "order_chunks")).withColumn("r", rebuild.limit_pieces(F.col("pieces"), 3))
    return made.select("symbol_id", F.col("r.code").alias("rendered"), F.col("r.omitted").alias("omitted"))


def symbol_truncate_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").withColumn("r", rebuild.truncate_chars(F.col("content"), F.lit(10), 400))
    return files.select("doc_id", "r.*")


def symbol_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rebuild.n_lines(F.col("content"))
    files = load(spark, sf_dir, "files").withColumn("r", rebuild.line_range(F.col("content"), F.lit(10), lines + 9, (F.col("doc_id") % 5 + 9).cast("int"), (F.col("doc_id") % 4 + 10).cast("int")))
    return files.select("doc_id", "r.*")


QUERIES = {f.__name__: f for f in (lookup_tiers, lookup_scoped, lookup_auto_select, symbol_descendants, symbol_rebuild_body, symbol_signature_tree, symbol_max_lines, symbol_truncate_chars, symbol_line_range)}
_BODY = "SELECT symbol_id, string_agg(content, '' ORDER BY piece_index) AS code, max(CASE WHEN piece_index = 0 THEN signature END) AS signature FROM {order_chunks} GROUP BY symbol_id"
#: Lines with their ends; the tables know only the line feed.
_LINES = lambda c: f"list_filter(regexp_extract_all({c}, '[^\\n]*\\n|[^\\n]+$'), lambda x: x <> '')"
ORACLE_SQL = {
    "lookup_tiers": text(f"WITH {_matches_sql('')} SELECT query, match_kind, id, path, ord FROM matches"),
    "lookup_scoped": text(f"WITH {_matches_sql(_IN_SCOPE)} SELECT query, match_kind, id, pieces FROM matches"),
    "lookup_auto_select": text(
        f"WITH {_matches_sql(_IN_SCOPE)} SELECT q.query, count(m.id) AS n_matches, CASE WHEN count(m.id) = 1 THEN min(m.id) END AS selected_id FROM {_ASKED} q LEFT JOIN matches m ON m.query = q.query GROUP BY q.query"
    ),
    "symbol_descendants": text(
        "WITH RECURSIVE tree AS (SELECT id AS root, id, 0 AS depth, type IN ('file', 'class') AS grows FROM {symbols} WHERE id IN ('r:1', 'n:7', 's:3') "
        "UNION ALL SELECT t.root, s.id, t.depth + 1, t.grows FROM tree t JOIN {symbols} s ON s.parent_id = t.id WHERE t.grows) SELECT root, id, depth FROM tree"
    ),
    "symbol_rebuild_body": text(_BODY),
    "symbol_signature_tree": text(
        "SELECT id AS root, id, 0 AS depth, signature FROM {symbols} WHERE id IN ('r:1', 'n:7', 's:3') UNION ALL "
        "SELECT r.id, s.id, 1, s.signature FROM {symbols} s JOIN {symbols} r ON s.parent_id = r.id WHERE r.id IN ('r:1', 'n:7') AND r.type IN ('file', 'class')"
    ),
    "symbol_max_lines": text(
        "SELECT symbol_id, CASE WHEN count(*) <= 3 THEN string_agg(content, '' ORDER BY piece_index) ELSE concat(string_agg(content, '' ORDER BY piece_index) FILTER (piece_index < 3), '# ... ', count(*) - 3, "
        "' more lines omitted, use detail=\"signature\" or read_file for the rest ...') END AS rendered, greatest(count(*) - 3, 0) AS omitted FROM {order_chunks} GROUP BY symbol_id"
    ),
    "symbol_truncate_chars": text(
        f"""WITH l AS (SELECT doc_id, content, {_LINES("content")} AS lines FROM {{files}}),
        u AS (SELECT *, coalesce(list_max(list_filter(list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: length(x)))), lambda n: n <= 383)), 0) AS used FROM l),
        p AS (SELECT *, substr(content, 1, CASE WHEN used > 0 THEN used ELSE 383 END::BIGINT) AS prefix FROM u)
        SELECT doc_id, CASE WHEN length(content) <= 400 THEN content ELSE prefix || '...(truncated)...' END AS code, length(content) > 400 AS truncated,
               CASE WHEN length(content) > 400 THEN 10 + greatest(len({_LINES("prefix")}) - 1, 0) END AS returned_end_line, CASE WHEN length(content) > 400 THEN len(lines) END AS total_lines FROM p"""
    ),
    "symbol_line_range": text(
        f"""WITH l AS (SELECT doc_id, {_LINES("content")} AS lines, (doc_id % 5 + 9)::INT AS f, (doc_id % 4 + 10)::INT AS t FROM {{files}}),
        e AS (SELECT *, greatest(f, 10) AS a, least(t, len(lines) + 9) AS b, CASE WHEN f < 1 OR t < f THEN 'INVALID_RANGE' WHEN greatest(f, 10) > least(t, len(lines) + 9) THEN 'RANGE_EMPTY' END AS error FROM l)
        SELECT doc_id, error, CASE WHEN error IS NULL THEN a END AS start_line, CASE WHEN error IS NULL THEN b END AS end_line,
               CASE WHEN error IS NULL THEN array_to_string(lines[a - 9 : b - 9], '') END AS code FROM e"""
    ),
}
