"""The engine's relations, derived from the given tables by SQL that Spark and DuckDB both read.

``{name}`` in a text stands for a table; :func:`load` runs a text in Spark, :func:`text` gives it to another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TAG = "geo::main::chunks"

SQL = {
    # a tree: regions are files, nations classes, suppliers and customers methods
    "symbols": """
        SELECT concat('r:', r_regionkey) AS id, 'file' AS type, r_name AS name, CAST(NULL AS STRING) AS parent_id, 1 AS start_line, 100000 AS end_line,
               concat('geo/', r_name, '.txt') AS path, md5(r_name) AS cache_key, concat('file ', r_name) AS signature FROM {region}
        UNION ALL
        SELECT concat('n:', n_nationkey), 'class', n_name, concat('r:', n_regionkey), n_nationkey * 1000 + 1, n_nationkey * 1000 + 1000,
               concat('geo/', r_name, '.txt'), md5(r_name), concat('class ', n_name, ':') FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('s:', s_suppkey), 'method', s_name, concat('n:', s_nationkey), s_nationkey * 1000 + 2 + CAST(s_suppkey % 900 AS INT), s_nationkey * 1000 + 4 + CAST(s_suppkey % 900 AS INT),
               concat('geo/', r_name, '.txt'), md5(r_name), concat('def ', s_name, '():') FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('c:', c_custkey), 'method', c_name, concat('n:', c_nationkey), c_nationkey * 1000 + 2 + CAST(c_custkey % 900 AS INT), c_nationkey * 1000 + 4 + CAST(c_custkey % 900 AS INT),
               concat('geo/', r_name, '.txt'), md5(r_name), concat('def ', c_name, '():') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    # suppliers have one piece or two, nations three
    "symbol_chunks": """
        SELECT concat('s:', s_suppkey, ':', p.i) AS id, concat('s:', s_suppkey) AS symbol_id, md5(r_name) AS cache_key, concat('geo/', r_name, '.txt') AS path, p.i AS piece_index
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) p WHERE p.i <= s_suppkey % 2
        UNION ALL
        SELECT concat('n:', n_nationkey, ':', p.i), concat('n:', n_nationkey), md5(r_name), concat('geo/', r_name, '.txt'), p.i
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) p
    """,
    # only three regions are tagged in the scope
    "symbol_tags": """
        SELECT CASE WHEN path IN ('geo/ASIA.txt', 'geo/EUROPE.txt', 'geo/AMERICA.txt') THEN 'geo::main::chunks' ELSE 'geo::other::chunks' END AS tag, id AS chunk_id FROM {symbol_chunks}
    """,
    # orders are symbols, their lines pieces
    "order_chunks": """
        SELECT concat(l_orderkey, ':', i) AS id, CAST(l_orderkey AS STRING) AS symbol_id, i AS piece_index, n AS piece_count, i AS idx, i + 1 AS start_line, i + 1 AS end_line,
               CASE WHEN i > 0 THEN concat(l_orderkey, ':', i - 1) END AS prev_chunk, CASE WHEN i < n - 1 THEN concat(l_orderkey, ':', i + 1) END AS next_chunk,
               concat('part ', l_partkey, ' x ', CAST(l_quantity AS INT), chr(10)) AS content, concat('order ', l_orderkey, ' line ', i) AS signature
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS i,
                     CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n FROM {lineitem}) x
    """,
    "files": """
        SELECT doc_id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, text AS content, source AS dir, lang AS branch,
               octet_length(text) AS size, 1700000000000 + doc_id * 1000 AS last_modified, lower(sha2_hex(text)) AS cache_key FROM {documents}
    """,
    # what was indexed before: one path in ten is new, one in five has changed, two in three are older than the file
    "catalog": """
        SELECT path, dir, branch, lower(sha2_hex(CASE WHEN doc_id % 5 = 1 THEN concat(content, ' v0') ELSE content END)) AS cache_key,
               last_modified - CASE WHEN doc_id % 3 <> 0 THEN 5000 ELSE 0 END AS last_updated FROM {files} WHERE doc_id % 10 <> 0
        UNION ALL
        SELECT concat('gone/', path), dir, branch, cache_key, last_modified FROM {files} WHERE doc_id % 17 = 3
        UNION ALL
        SELECT path, dir, branch, lower(sha2_hex(concat(content, ' older'))), last_modified - 9000 FROM {files} WHERE doc_id % 10 <> 0 AND doc_id % 7 = 2
    """,
    "global_cache": """
        SELECT DISTINCT cache_key, dir, branch, 'chunks' AS artifact_id FROM {catalog}
        UNION
        SELECT DISTINCT cache_key, 'elsewhere', branch, 'chunks' FROM {files} WHERE doc_id % 4 = 1
    """,
    "doc_chunks": """
        SELECT concat(doc_id, ':', i) AS id, path, cache_key, doc_id, i AS piece_index FROM {files} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE i <= doc_id % 3
    """,
    "doc_tags": "SELECT concat(dir, '::', branch, '::chunks') AS tag, concat(doc_id, ':', i) AS chunk_id FROM {files} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) p WHERE i <= doc_id % 3",
    "snippets": """
        SELECT doc_id AS id, path, cache_key, concat('title_', doc_id % 50) AS title, content, concat('def title_', doc_id % 50, '()') AS signature,
               CAST(doc_id % 7 AS INT) AS start_line, CAST(doc_id % 7 + 3 AS INT) AS end_line, concat(dir, '::', branch, '::codeSnippets') AS tag FROM {files}
    """,
}
_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a relation over them, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, SQL[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(sql))}
    return spark.sql(_spark(sql), **used)


def _calls(sql: str, name: str, make) -> str:
    """Replaces calls of name with what make gives for the argument."""
    while (at := sql.find(f"{name}(")) >= 0:
        depth, i = 0, at + len(name)
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
            if not depth:
                break
        sql = sql[:at] + make(sql[at + len(name) + 1 : i - 1]) + sql[i:]
    return sql


def _spark(sql: str) -> str:
    return _calls(sql, "sha2_hex", lambda x: f"sha2({x}, 256)")


def text(sql: str) -> str:
    """SQL for DuckDB: WITH clauses for the relations that are used, then the query."""
    parts: dict[str, str] = {}

    def add(body: str) -> str:
        for n in _NAME.findall(body):
            if n in SQL and n not in parts:
                inner = add(SQL[n])
                parts[n] = inner
        return _NAME.sub(lambda m: m[1], body)

    body = add(sql)
    duck = lambda s: _calls(s, "sha2_hex", lambda x: f"sha256({x})").replace("octet_length(text)", "octet_length(encode(text))").replace("AS STRING)", "AS VARCHAR)")
    lead = ", ".join(f"{n} AS ({duck(p)})" for n, p in parts.items())
    body = duck(body).strip()
    if not lead:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {lead}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {lead}, {body[4:]}"
    return f"WITH {lead} {body}"
