"""Text, URI, token, chat, ignore, tool and stream queries, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as fx
from quarrylight.functions import tokens, uris
from quarrylight.operators import chat, outline, tools
from quarrylight.plans.index_queries import TOKEN_SQL
from quarrylight.plans.lookup_queries import _IN_SCOPE, _matches, _matches_sql, asked
from quarrylight.sources import ignore
from quarrylight.sources.relations import TAG, load, run, text
from quarrylight.sources.shared import shared_dir
from quarrylight.streaming import watch

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = text(sql)
        return f

    return put


# ---------------------------------------------------------------- URIs

DIRS = ["http://ththre.example.com/fr", "https://thther.example.org/en"]
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_CLEAN = f"regexp_replace(regexp_replace({_PATH}, '^/', ''), '/$', '')"
_BASE = f"url_decode(replace(split_part({_CLEAN}, '/', -1), '+', '%2B'))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", "url")


@query(f"SELECT page_id, {_BASE} AS value FROM pages")
def uri_basename(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", uris.uri_basename(F.col("url")).alias("value"))


@query(f"SELECT page_id, CASE WHEN contains({_BASE}, '.') THEN lower(split_part({_BASE}, '.', -1)) ELSE '' END AS value FROM (SELECT page_id, concat(split_part(url, '?', 1), '.Html') AS url FROM pages)")
def uri_extension(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", uris.uri_extension(F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".Html"))).alias("value"))


@query(f"WITH p AS (SELECT page_id, regexp_split_to_array({_CLEAN}, '[\\\\/]') AS parts FROM pages) SELECT page_id, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') AS value FROM p")
def uri_last_parts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", fx.last_parts(uris.clean_path(F.col("url")), 2).alias("value"))


def _found_sql(want: str) -> str:
    arms = ""
    for d in DIRS:
        scheme, rest = d.split("://")
        path = rest.split("/", 1)[1]
        arms += f" WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) = '{scheme}' AND ({_CLEAN} = '{path}' OR starts_with({_CLEAN}, '{path}/')) THEN "
        arms += f"url_decode(replace(substr({_CLEAN}, {len(path) + 2}), '+', '%2B'))" if want == "relative" else f"'{d}'"
    return f"CASE{arms} ELSE {_BASE if want == 'relative' else 'NULL'} END"


@query(f"SELECT page_id, {_found_sql('relative')} AS relative, {_found_sql('dir')} AS found_in FROM pages")
def uri_find_in_dirs(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("r", uris.find_in_dirs(F.col("url"), DIRS)).select("page_id", "r.relative", "r.found_in")


@query(
    f"""WITH r AS (SELECT DISTINCT url, string_split({_CLEAN}, '/') AS parts FROM (SELECT concat('file:///w/', split_part(url, '://', 2)) AS url FROM pages)),
    rel AS (SELECT url, parts[2:] AS parts FROM r),
    ends AS (SELECT url, parts, n, array_to_string(parts[len(parts) - n + 1:], '/') AS e FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM rel)),
    once AS (SELECT e FROM ends GROUP BY e HAVING count(*) = 1)
    SELECT url AS uri, coalesce(min_by(e, n) FILTER (e IN (SELECT e FROM once)), array_to_string(any_value(parts), '/')) AS unique_path FROM ends GROUP BY url"""
)
def uri_shortest_unique(spark, sf_dir):
    rows = _pages(spark, sf_dir).select(F.concat(F.lit("file:///w/"), F.split_part("url", F.lit("://"), F.lit(2))).alias("url")).distinct()
    return uris.shortest_unique(rows, "url", ["file:///w"])


_RESTORED = "replace(replace(replace(replace(replace(replace(replace(url_encode(text), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~')"


@query(f"SELECT doc_id, {_RESTORED} AS value FROM documents")
def uri_encode(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", uris.encode_component(F.col("text")).alias("value"))


# ---------------------------------------------------------------- text


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query("SELECT doc_id, sha256(text) AS value FROM documents")
def hash_cache_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fx.content_hash(F.col("text")).alias("value"))


@query(
    """WITH t AS (SELECT doc_id, repeat(concat('/', source), 40 * (doc_id % 3)::INT + 1) AS d, lang FROM documents)
    SELECT doc_id, CASE WHEN length(d) + length(lang) + 10 <= 240 THEN concat(d, '::', lang, '::chunks')
    ELSE concat(substr(md5(d), 1, 8), '_', right(d, 240 - 13 - length(lang) - 6), '::', lang, '::chunks') END AS value FROM t"""
)
def tag_to_string(spark, sf_dir):
    d = F.repeat(F.concat(F.lit("/"), F.col("source")), (40 * (F.col("doc_id") % 3) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", fx.tag_text(d, F.col("lang"), F.lit("chunks")).alias("value"))


@query(
    """WITH t AS (SELECT doc_id, text, list_reverse(string_split(text, '')) AS c FROM documents),
    s AS (SELECT *, [octet_length(encode(x)) FOR x IN c[1:100]] AS n FROM t)
    SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE array_to_string(list_reverse(c[1:len(list_filter(range(1, len(n) + 1), lambda i: list_sum(n[1:i]) <= 100))]), '') END AS value FROM s"""
)
def truncate_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fx.last_bytes(F.col("text"), 100).alias("value"))


@query(r"SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS value FROM documents")
def first_line_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fx.first_line(F.col("text")).alias("value"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS value FROM documents")
def line_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fx.line_count(F.col("text")).alias("value"))


@query(
    r"""WITH l AS (SELECT doc_id, [regexp_replace(regexp_replace(trim(concat('// ', x)), '^(?://+|;+|#+|\*+)\s?', ''), '\s+$', '') FOR x IN string_split(text, chr(10))] AS x FROM documents)
    SELECT doc_id, regexp_replace(array_to_string(x, chr(10)), '^\n+|\n+$', '', 'g') AS value FROM l"""
)
def clean_doc(spark, sf_dir):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("// "), x)), "\n")
    return _docs(spark, sf_dir).select("doc_id", fx.clean_doc(marked).alias("value"))


_LANG = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in fx.FENCES.items()) + " ELSE '' END"
_EXT = list(fx.FENCES) + ["TXT", "unknown", "Py"]


@query(f"SELECT doc_id, {_LANG} AS value FROM (SELECT doc_id, lower([{', '.join(repr(x) for x in _EXT)}][doc_id % {len(_EXT)} + 1]) AS e FROM documents)")
def fence_language(spark, sf_dir):
    end = F.get(F.array(*[F.lit(x) for x in _EXT]), (F.col("doc_id") % len(_EXT)).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", fx.fence_language(F.concat(F.lit("dir.d/file."), end)).alias("value"))


# ---------------------------------------------------------------- tokens


@query(f"SELECT doc_id, {TOKEN_SQL.format('text')} AS value FROM documents")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens.count(F.col("text")).alias("value"))


@query(f"SELECT doc_id, ceil({TOKEN_SQL.format('text')} * [1.0, 1.23, 1.18, 1.26, 1.26][doc_id % 5 + 1]::DOUBLE)::BIGINT AS value FROM documents")
def token_adjusted(spark, sf_dir):
    model = F.get(F.array(*[F.lit(x) for x in ("llama2", "Claude-x", "gemini-pro", "codestral", "mixtral")]), (F.col("doc_id") % 5).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", tokens.adjusted(tokens.count(F.col("text")), model).alias("value"))


_PRUNE = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 c AS (SELECT *, {TOKEN_SQL.format("line")} + 1 AS t FROM l),
 k AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i {{order}} ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM c)
 SELECT d.doc_id, coalesce(v, '') AS value FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS v FROM k WHERE upto <= 50 GROUP BY doc_id) x ON x.doc_id = d.doc_id"""


@query(_PRUNE.replace("{order}", "DESC"))
def prune_lines_top(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens.prune_lines(F.col("text"), 50, top=True).alias("value"))


@query(_PRUNE.replace("{order}", "ASC"))
def prune_lines_bottom(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens.prune_lines(F.col("text"), 50, top=False).alias("value"))


# ---------------------------------------------------------------- chat


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


@query(f"SELECT conv_id, turn, 4 + {TOKEN_SQL.format('text')} AS n_tokens FROM conversations")
def chat_message_tokens(spark, sf_dir):
    return _chat(spark, sf_dir).select("conv_id", "turn", tokens.message(F.col("role"), F.col("content")).alias("n_tokens"))


_TAIL = """m AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, first_value(role) OVER w AS last FROM conversations
    WHERE role <> 'system' AND regexp_matches(text, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
  b AS (SELECT *, coalesce(sum(CASE WHEN role NOT IN ('assistant', 'thinking') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS broken FROM m),
  t AS (SELECT *, CASE WHEN last = 'assistant' THEN broken = 0 ELSE i = 1 END AS in_tail FROM b)"""


@query(f"WITH {_TAIL} SELECT conv_id, turn, in_tail FROM t")
def chat_tool_sequence(spark, sf_dir):
    rows = _chat(spark, sf_dir)
    return chat.tail(rows.filter((F.col("role") == "system") | ~chat.is_empty(F.col("content")))).select("conv_id", "turn", "in_tail")


@query(
    f"""WITH {_TAIL}, s AS (SELECT conv_id, min(turn) AS st, 4 + {TOKEN_SQL.format("min_by(text, turn)")} AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id),
    n AS (SELECT t.*, 4 + {TOKEN_SQL.format("text")} AS tok, coalesce(sys, 0) AS sys, st FROM t LEFT JOIN s ON s.conv_id = t.conv_id),
    r AS (SELECT *, 1500 - 30 - 1000 - sys - sum(CASE WHEN in_tail THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS room,
          sum(CASE WHEN in_tail THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS held FROM n),
    f AS (SELECT *, in_tail OR held <= room AS kept, bool_or(NOT (in_tail OR held <= room)) OVER (PARTITION BY conv_id) AS did_prune FROM r)
    SELECT conv_id, turn, role, did_prune FROM f WHERE kept UNION SELECT conv_id, st, 'system', did_prune FROM f WHERE st IS NOT NULL"""
)
def chat_compile(spark, sf_dir):
    return chat.compile_history(_chat(spark, sf_dir), 1500, 4096, strict=False).select("conv_id", "turn", "role", "did_prune")


# ---------------------------------------------------------------- ignore rules, tools

PATTERNS = ["*.log", "!keep.log", "src1/", "/src2/en/*_1?.txt", "**/fr/doc_?.txt", "src3/**/doc_2*", "[ab]*.md", "doc_77.txt"]


def _ignore_sql() -> str:
    out = "false"
    for expression, ignores in ignore.merged([*PATTERNS, *ignore.DEFAULTS]):
        out = f"CASE WHEN regexp_matches(path, '{expression.replace(chr(39), chr(39) * 2)}') THEN {str(ignores).lower()} ELSE {out} END"
    return out


_NAMED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(path, '.log') WHEN 1 THEN concat(dir, '/keep.log') WHEN 2 THEN concat('x/.cache/', path) ELSE path END AS path FROM {files}"


@query(f"SELECT doc_id, {_ignore_sql()} AS ignored FROM ({_NAMED})")
def ignore_filter(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", ignore.ignored(F.col("path"), [*PATTERNS, *ignore.DEFAULTS]).alias("ignored"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _NAMED)


@query(f"SELECT doc_id, regexp_matches(path, '(?:^|/)\\.') AS hidden FROM ({_NAMED})")
def hidden_filter(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", fx.is_hidden(F.col("path")).alias("hidden"))


_NO = "  [error SYMBOL_NOT_FOUND] symbol doesn''t exist of index. Use `grep`"


@query(
    f"""WITH {_matches_sql(_IN_SCOPE)}, q AS (SELECT unnest(['NATION_7', 'nation_3', 'ation_1', 'amer', 'Supplier#000000007', 'CUSTOMER#000000011', 'AsIa', 'no such name', '']) AS query)
    SELECT q.query, concat('query: ', q.query, chr(10), coalesce(string_agg(concat('  - ', path, ':', start_line, '-', end_line, '  id=', id, '  (', name, ')', chr(10), signature), chr(10) ORDER BY ord) FILTER (m.id IS NOT NULL), '{_NO}')) AS text
    FROM q LEFT JOIN matches m ON m.query = q.query GROUP BY q.query"""
)
def format_lookup_text(spark, sf_dir):
    return tools.format_matches(_matches(spark, sf_dir, [TAG]), asked(spark))


@query(f"WITH {_matches_sql('')} SELECT query, ord, id AS symbol_id, path, start_line, end_line, signature, CAST(NULL AS VARCHAR) AS error FROM matches WHERE query IN ('ation_1', 'AsIa')")
def lookup_tool_response(spark, sf_dir):
    wanted = asked(spark).filter(F.col("query").isin("ation_1", "AsIa"))
    return tools.lookup_response(_matches(spark, sf_dir, None).filter(F.col("query").isin("ation_1", "AsIa")), wanted)


# ---------------------------------------------------------------- streams


@query(
    """WITH t AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
    e AS (SELECT concat('u/', user_id) AS path, epoch_us(ts) AS us, lo + (hi - lo) // 3 AS one, lo + 2 * ((hi - lo) // 3) AS two FROM events, t),
    b AS (SELECT path, max(us) AS mtime FROM e WHERE us < two GROUP BY path), n AS (SELECT path, max(us) AS mtime FROM e WHERE us >= one GROUP BY path)
    SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM b FULL JOIN n ON b.path = n.path WHERE b.mtime IS DISTINCT FROM n.mtime"""
)
def snapshot_diff(spark, sf_dir):
    """Snapshots of the first and the last two thirds of the events' time."""
    events = load(spark, sf_dir, "events").select(F.concat(F.lit("u/"), F.col("user_id")).alias("path"), watch.wall_micros("ts").alias("at"))
    lo, hi = events.agg(F.min("at"), F.max("at")).first()
    third = ((hi or 0) - (lo or 0)) // 3
    last = lambda inside: events.filter(inside).groupBy("path").agg(F.max("at").alias("mtime"))
    return watch.snapshot_diff(last(F.col("at") < (lo or 0) + 2 * third), last(F.col("at") >= (lo or 0) + third))


WAIT_MS = 600_000


@query(
    f"""WITH RECURSIVE e AS (SELECT event_type AS stream, epoch_us(ts) AS at_us, concat('p/', user_id % 40) AS path FROM events),
    o AS (SELECT stream, min(at_us) AS batch_start FROM e GROUP BY stream
          UNION ALL SELECT o.stream, (SELECT min(at_us) FROM e WHERE e.stream = o.stream AND e.at_us >= o.batch_start + {WAIT_MS} * 1000) FROM o
          WHERE EXISTS (SELECT 1 FROM e WHERE e.stream = o.stream AND e.at_us >= o.batch_start + {WAIT_MS} * 1000))
    SELECT e.stream, o.batch_start, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM e JOIN o ON o.stream = e.stream AND e.at_us >= o.batch_start AND e.at_us < o.batch_start + {WAIT_MS} * 1000 GROUP BY e.stream, o.batch_start"""
)
def watch_debounce(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), "ts", F.concat(F.lit("p/"), F.col("user_id") % 40).alias("path"))
    return watch.debounce(rows, WAIT_MS).select("stream", "batch_start", F.array_join("paths", ",").alias("paths"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return watch.windowed_counts(load(spark, sf_dir, "events").select("ts", "event_type"))


@query("SELECT user_id, max_by(event_type, (ts, event_type)) AS last_op FROM (SELECT user_id, event_type, ts, event_id FROM events) GROUP BY user_id")
def watch_stream_apply(spark, sf_dir):
    """Events read as a stream; every batch replaces the last event of its paths in a stored table."""
    schema = load(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "ts", "event_type")

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    watch.start_refresh(stream.withColumnRenamed("user_id", "path"), apply, f"{base}/checkpoint", once=True).awaitTermination()
    table = spark.read.parquet(f"{base}/table")
    return watch.latest_event(table.drop("batch")).select(F.col("path").alias("user_id"), F.col("event_type").alias("last_op"))


# ---------------------------------------------------------------- outline

_SOURCE = 'class Doc{0}(Base):\n    """About {0}."""\n\n    size = {0}\n\n    def read(self, n):\n        return n + {0}\n\n\ndef load_{0}(x):\n    y = x * {0}\n    return y\n'


def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up sources, one for each document."""
    n = F.col("doc_id").cast("string")
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("pkg/mod_"), n, F.lit(".py")).alias("path"), F.replace(F.lit(_SOURCE), F.lit("{0}"), n).alias("content"))


@query(
    """SELECT concat('pkg/mod_', doc_id, '.py') AS path, type, replace(name, '{0}', doc_id::VARCHAR) AS name, a AS start_line, b AS end_line FROM documents,
    (VALUES ('file', 'mod_{0}.py', 1, 13), ('class', 'Doc{0}', 1, 7), ('method', 'read', 6, 7), ('method', 'load_{0}', 10, 12)) s(type, name, a, b)"""
)
def code_outline(spark, sf_dir):
    symbols, _ = outline.outline_files(code_sources(spark, sf_dir))
    return symbols.select("path", "type", "name", "start_line", "end_line")
