"""Chat formatting by quotation linking, with DataFrame functions only.

Lines are parsed for nested quote marks. Quoted passages and their lines are normalised and hashed, and joined to the
earlier messages of the conversation that say them. A message that quotes replies to the message it quotes; others
reply to the message before them. Conversations are built in reply order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import free_name, materialise, quoted, set_aside

#: Quote marks at the start of a line, with or without spaces between and after them.
MARKS = r"^[\x20\t]*>(?:[\x20\t]*>)*[\x20\t]?"
#: A line that only introduces a quote.
INTRODUCTION = r"(?i)^[\x20\t]*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[\x20\t]*:[\x20\t\r]*$"
#: Turns that one task scans in order; conversations are cut into ranges of so many turns.
RANGE_TURNS = 4096
#: Stands for the messages before all branches; no turn.
_TOP = -(1 << 62)


def normalised(text: Column) -> Column:
    """Lower case, white space of any length as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines of a text."""

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), parse)


def _passages(messages: DataFrame) -> DataFrame:
    """messages (..., lines) with a row for each run of lines of one quote level above 0: level, bodies."""
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get(F.col("lines"), i - 1)["level"] != F.col("lines")[i]["level"]))
    cut = messages.withColumn("_at", begins)
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("lines")))
    runs = cut.withColumn("_runs", F.arrays_zip(F.col("_at").alias("a"), ends.alias("b")))
    quoted_runs = F.filter("_runs", lambda x: F.col("lines")[x["a"]]["level"] > 0)
    made = F.transform(quoted_runs, lambda x: F.struct(F.col("lines")[x["a"]]["level"].alias("level"), F.transform(F.slice("lines", x["a"] + 1, x["b"] - x["a"]), lambda y: y["body"]).alias("bodies")))
    return runs.select(*[c for c in messages.columns if c != "lines"], F.explode(made).alias("_p")).select("*", "_p.*").drop("_p")


def without_quotes(lines: Column) -> Column:
    """The text of the lines at level 0, without those that introduce a quote, trimmed."""
    own = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda x, after: F.when((x["level"] == 0) & ~(x["body"].rlike(INTRODUCTION) & (F.coalesce(after["level"], F.lit(0)) > 0)), x["body"]))
    return F.regexp_replace(F.array_join(F.filter(own, lambda x: x.isNotNull()), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _last_before(rows: DataFrame, keys: list[str], value: str, inclusive: bool) -> DataFrame:
    """rows (keys, turn, value) with before: the greatest value at an earlier turn (or the same, if inclusive).

    Each range of turns is scanned by itself and takes what earlier ranges end with, so a key may hold any number of rows.
    """
    rows = rows.withColumn("_range", F.floor(F.col("turn") / RANGE_TURNS))
    frame = Window.partitionBy(*keys, "_range").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = rows.groupBy(*keys, "_range").agg(F.max(value).alias("_end"))
    carry = ends.withColumn("_carry", F.max("_end").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).filter("_carry IS NOT NULL").drop("_end")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_range"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    local = rows.withColumn("_local", F.max(value).over(frame))
    return local.alias("r").join(carry.alias("c"), on, "left").select(*[F.col(f"r.{c}").alias(c) for c in rows.columns if c != "_range"], F.greatest("r._local", "c._carry").alias("before"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, quoted): for each message with a quote that an earlier message of its conversation says.

    Pieces are whole passages and lines of them, at all levels. reply_to is the turn that says the longest piece of the
    outermost level of which one is found; of equally long pieces and of several turns that say one, the latest turn
    counts. quoted counts the pieces found.
    """
    marked = messages.filter(F.col("text").contains(">")).select("conv_id", "turn", _lines(F.col("text")).alias("lines"))
    said_at = F.array_union(F.array(normalised(F.array_join("bodies", " "))), F.transform("bodies", lambda b: normalised(b)))
    wanted = _passages(marked).select("conv_id", "turn", "level", F.explode(said_at).alias("piece")).filter("piece <> ''").distinct()
    quotes = wanted.select("conv_id", "turn", F.sha2("piece", 256).alias("hash"), "level", F.length("piece").alias("length"), F.lit(None).cast("long").alias("said"))
    # what messages say: the whole of it, and every line
    quoting = quotes.select("conv_id").distinct()
    own = messages.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", without_quotes(_lines(F.col("text"))).alias("own"))
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(F.concat(F.array(normalised(F.col("own"))), F.transform(F.split("own", "\n"), lambda x: normalised(x))), lambda x: x != ""))).alias("piece"))
    said = said.select("conv_id", "turn", F.sha2("piece", 256).alias("hash"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("length"), F.col("turn").cast("long").alias("said"))
    found = _last_before(quotes.union(said), ["conv_id", "hash"], "said", inclusive=False).filter("length IS NOT NULL AND before IS NOT NULL")
    return found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "length", "before"))["before"].alias("reply_to"), F.count_distinct("hash").alias("quoted"))


def branch_order(tree: DataFrame) -> DataFrame:
    """(conv_id, branch, rank, depth) of the branches of a tree (conv_id, branch, parent, up), above them first.

    Branches of one branch come in the order of their parents' turns, the latest first, then by their own. The walk
    through the tree is a list of ends of branches, each of which knows the one before it; pointers are doubled, so
    a chain of n branches takes about log2(n) rounds, and every row stays small.
    """
    t = tree.select("conv_id", "branch", F.col("parent").cast("long").alias("parent"), F.coalesce("up", F.lit(_TOP)).alias("up"))
    same = _last_before(t.select("conv_id", "parent", F.col("branch").alias("turn"), F.col("branch").alias("value")), ["conv_id", "parent"], "value", inclusive=False)
    same = same.select("conv_id", F.col("turn").alias("branch"), F.col("before").alias("sibling"))
    groups = materialise(t.groupBy("conv_id", "up", "parent").agg(F.max("branch").alias("last")), "siblings")
    later = _last_before(groups.select("conv_id", "up", (-F.col("parent")).alias("turn"), (-F.col("parent")).alias("value")), ["conv_id", "up"], "value", inclusive=False)
    later = later.select("conv_id", "up", (-F.col("turn")).alias("parent"), (-F.col("before")).alias("at"))
    later = later.join(groups.select("conv_id", "up", F.col("parent").alias("at"), "last"), ["conv_id", "up", "at"], "left").select("conv_id", "parent", "last")
    final = groups.groupBy("conv_id", "up").agg(F.max(F.struct(-F.col("parent"), "last"))["last"].alias("child")).withColumnRenamed("up", "branch")
    known = t.join(same, ["conv_id", "branch"], "left").join(later, ["conv_id", "parent"], "left").join(final, ["conv_id", "branch"], "left")
    known = known.withColumn("sibling", F.coalesce("sibling", "last"))
    begin = known.select("conv_id", F.col("branch").alias("node"), F.lit(0).alias("side"), F.coalesce("sibling", F.when(F.col("up") != _TOP, F.col("up"))).alias("to"), F.when(F.col("sibling").isNotNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("rank"), F.lit(1).cast("long").alias("depth"))
    end = known.select("conv_id", F.col("branch").alias("node"), F.lit(1).alias("side"), F.coalesce("child", "branch").alias("to"), F.when(F.col("child").isNotNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("rank"), F.lit(-1).cast("long").alias("depth"))
    now = materialise(begin.union(end), "walk")
    while now.filter("`to` IS NOT NULL").limit(1).count():
        ahead = now.select("conv_id", F.col("node").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("then"), F.col("to_side").alias("then_side"), F.col("rank").alias("_rank"), F.col("depth").alias("_depth"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        now = materialise(now.join(ahead, ["conv_id", "to", "to_side"], "left").select("conv_id", "node", "side", F.col("then").alias("to"), F.coalesce("then_side", F.lit(0)).alias("to_side"), more("rank"), more("depth")), "walk")
    return now.filter("side = 0").select("conv_id", F.col("node").alias("branch"), "rank", "depth")


def branches(messages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with branch, (conv_id, branch, rank, depth)).

    A message that replies to another turn than the one before starts a branch, named by its turn; others go on with
    the branch before them. Sorting by rank and turn puts a reply behind what it replies to.
    """
    starts = links.join(messages.select("conv_id", "turn", "previous"), ["conv_id", "turn"]).filter("NOT (reply_to <=> previous)").select("conv_id", F.col("turn").cast("long").alias("branch"), F.col("reply_to").alias("parent"))
    starts = materialise(starts.distinct(), "branches")
    marked = messages.join(starts.select("conv_id", F.col("branch").alias("turn"), F.lit(True).alias("_starts")), ["conv_id", "turn"], "left").withColumn("_first", F.when(F.col("_starts"), F.col("turn").cast("long")))
    placed = _last_before(marked, ["conv_id"], "_first", inclusive=True).withColumnRenamed("before", "branch").drop("_starts", "_first")
    if not starts.limit(1).count():
        return placed, starts.select("conv_id", "branch", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("depth"))
    placed = materialise(placed, "placed")
    above = placed.select(F.col("conv_id"), F.col("turn").cast("long").alias("parent"), F.col("branch").alias("up")).distinct()
    return placed, branch_order(materialise(starts.join(above, ["conv_id", "parent"], "left"), "branch-tree"))


def reply_order(messages: DataFrame) -> DataFrame:
    """Every message in reply order: conv_id, turn, role, reply_to, depth, text (without quotes), n_quote_lines, and extra columns.

    reply_to is the turn that the message quotes, else the turn before it, null for the first. depth counts branches.
    Null texts are empty; turns that are null come first and reply to nothing; repeated rows are kept; messages of a null
    conv_id form one conversation whose quotes are not linked. Extra columns are kept unless they bear one of these names,
    which get a leading underscore. An empty table gives an empty table.
    """
    messages = set_aside(messages, "reply_to", "depth", "n_quote_lines")
    at_conv, at_turn, rank = (free_name(messages, x) for x in ("_at_conv", "_at_turn", "_reply_rank"))
    slim = messages.select("conv_id", "turn", "text")
    turns = slim.select("conv_id", "turn").filter("turn IS NOT NULL").distinct().withColumn("said", F.col("turn").cast("long"))
    ordered = _last_before(turns, ["conv_id"], "said", inclusive=False).select("conv_id", "turn", F.col("before").alias("previous"))
    ordered = materialise(ordered, "turns")
    links = materialise(link_quotes(slim.filter("conv_id IS NOT NULL AND turn IS NOT NULL")), "quote-links")
    placed, order = branches(ordered, links)
    place = placed.join(links, ["conv_id", "turn"], "left").join(order, ["conv_id", "branch"], "left")
    place = place.select(F.col("conv_id").alias(at_conv), F.col("turn").alias(at_turn), F.coalesce("reply_to", "previous").alias("reply_to"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("rank", F.lit(0)).alias(rank))
    place = materialise(place, "reply-order")
    lines = _lines(F.col("text"))
    extra = [c for c in messages.columns if c not in ("conv_id", "turn", "role", "text")]
    out = messages.join(place, messages["conv_id"].eqNullSafe(place[at_conv]) & (messages["turn"] == place[at_turn]), "left")
    plain = ~F.coalesce(F.col("text"), F.lit("")).contains(">")
    own = F.when(plain, F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).otherwise(without_quotes(lines))
    out = out.select("conv_id", "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).alias("depth"), own.alias("text"), F.when(plain, 0).otherwise(F.size(F.filter(lines, lambda x: x["level"] > 0))).alias("n_quote_lines"), *[F.col(quoted(c)) for c in extra], rank)
    return out.repartitionByRange("conv_id", rank, "turn").sortWithinPartitions("conv_id", rank, "turn").drop(rank)


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: For tables whose messages have no quote marks, as the given ones; tests hold the linking against brute force.
OP3_SQL = r"""
WITH l AS (
  SELECT conv_id, turn, role, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM conversations),
m AS (
  SELECT conv_id, turn, role, count(*) FILTER (regexp_matches(line, '^[ \t]*>')) AS n_quote_lines,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '^[ \t]*>')) AS own
  FROM l GROUP BY conv_id, turn, role)
SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to, 0 AS depth,
       regexp_replace(coalesce(own, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text, n_quote_lines
FROM m
"""


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with every third message behind a quote of the first line of the message two turns before."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    two_before = told.select(F.col("conv_id").alias("_c"), (F.col("turn") + 2).alias("_t"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("_line"))
    both = told.join(two_before, (told["conv_id"] == two_before["_c"]) & (told["turn"] == two_before["_t"]) & (told["turn"] % 3 == 2), "left")
    return both.select("conv_id", "turn", "role", F.when(F.col("_line").isNotNull(), F.concat(F.lit("> "), "_line", F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))


def quoted_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(quoted_conversations(spark, sf_dir)).drop("depth")


_NORMAL = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'))"
#: For tables whose messages have no quote marks of their own, as the given ones.
QUOTED_SQL = rf"""
WITH m AS (
  SELECT a.conv_id, a.turn, a.role, regexp_replace(coalesce(a.text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text,
         CASE WHEN a.turn % 3 = 2 AND b.turn IS NOT NULL THEN split_part(coalesce(b.text, ''), chr(10), 1) END AS quote,
         lag(a.turn) OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS previous
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2),
said AS (SELECT conv_id, turn, {_NORMAL.format("text")} AS piece FROM m UNION SELECT conv_id, turn, {_NORMAL.format("line")} FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m)),
found AS (
  SELECT m.conv_id, m.turn, max(s.turn) AS reply_to
  FROM m JOIN said s ON s.conv_id = m.conv_id AND s.turn < m.turn AND s.piece = {_NORMAL.format("m.quote")} WHERE s.piece <> '' GROUP BY m.conv_id, m.turn)
SELECT m.conv_id, m.turn, m.role, coalesce(f.reply_to, m.previous) AS reply_to, m.text, CASE WHEN m.quote IS NULL THEN 0 ELSE 1 END AS n_quote_lines
FROM m LEFT JOIN found f ON f.conv_id = m.conv_id AND f.turn = m.turn
"""
