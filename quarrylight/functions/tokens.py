"""Token counts and budgets. The tokenizer is a plug-in; the default counts words and signs with one regular expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of ASCII word characters, or one other character that is no white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
#: Multipliers by model name, the first that fits; image parts; buffers; default length.
MULTIPLIERS = (("claude", 1.23), ("gemini", 1.18), ("stral", 1.26), ("mixtral", 1.26))
IMAGE_TOKENS = 1024
BUFFER_MOST, BUFFER_SHARE = 1000, 0.02
LEAST_RESPONSE, DEFAULT_LENGTH = 1000, 128_000

Counter = Callable[[Column], Column]


def count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


def adjusted(n: Column, model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    factor = F.lit(1.0)
    for name, value in reversed(MULTIPLIERS):
        factor = F.when(low.contains(name), F.lit(value)).otherwise(factor)
    return F.ceil(n * factor).cast("long")


def for_model(model: str, counter: Counter = count) -> Counter:
    return lambda c: adjusted(counter(c), F.lit(model))


def buffer(context: Column) -> Column:
    return F.least(F.lit(float(BUFFER_MOST)), context * F.lit(BUFFER_SHARE)).cast("long")


def message(role: Column, content: Column, tool_call_id: Column | None = None, tool_calls: Column | None = None, counter: Counter = count) -> Column:
    """Tokens of a chat message: four, its content, its tool calls with ten each, and the id a tool answers."""
    n = F.lit(4) + counter(F.coalesce(content, F.lit("")))
    if tool_calls is not None:
        n = n + F.coalesce(F.aggregate(tool_calls, F.lit(0).cast("long"), lambda a, x: a + 10 + counter(x)), F.lit(0).cast("long"))
    if tool_call_id is not None:
        n = n + F.when(role == "tool", 10 + counter(F.coalesce(tool_call_id, F.lit("")))).otherwise(F.lit(0))
    return n.cast("long")


def tool_schemas(tools: Column, counter: Counter = count) -> Column:
    """Tokens of tool schemas: array<struct<name, description, fields: array<struct<name, type, description, values: array<string>>>>>."""
    zero = F.lit(0).cast("long")
    text = lambda c: counter(F.coalesce(c, F.lit("")))
    extra = lambda c: F.when(F.coalesce(c, F.lit("")) != "", text(c) + 2).otherwise(zero)
    values = lambda f: F.when(f["values"].isNotNull(), F.aggregate(f["values"], F.lit(-3).cast("long"), lambda b, v: b + 3 + text(v))).otherwise(zero)
    field = lambda a, f: a + text(f["name"]) + extra(f["type"]) + extra(f["description"]) + values(f)
    fields = lambda t: F.coalesce(F.aggregate(t["fields"], zero, field), zero)
    return F.when(F.size(tools) > 0, F.aggregate(tools, F.lit(24).cast("long"), lambda a, t: a + text(t["name"]) + text(t["description"]) + fields(t))).otherwise(zero)


def prune_lines(text: Column, most: Column | int, top: bool, counter: Counter = count) -> Column:
    """Whole lines dropped from the top (or bottom) until at most so many tokens are left; a line break counts one."""
    most = F.lit(most) if isinstance(most, int) else most
    lines = F.split(text, "\n")
    rows = lines if top else F.reverse(lines)
    cost = F.transform(rows, lambda x: counter(x) + 1)
    zero = F.lit(0).cast("long")
    total = F.aggregate(cost, zero, lambda a, x: a + x) - 1  # a break less than lines
    start = F.struct(total.alias("left"), F.lit(0).alias("dropped"))

    def drop(a: Column, x: Column) -> Column:
        return F.when(a["left"] > most, F.struct((a["left"] - x).alias("left"), (a["dropped"] + 1).alias("dropped"))).otherwise(a)

    # the last line has no break of its own: dropping it takes what is left to 0
    dropped = F.aggregate(cost, start, drop)["dropped"]
    kept = F.slice(rows, dropped + 1, F.size(rows))
    return F.array_join(kept if top else F.reverse(kept), "\n")


def prune_text(text: Column, most: int, top: bool) -> Column:
    """The last (or first) so many tokens, with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*(?:{TOKEN})[\x20\x09-\x0D]*"), F.lit(0))
    n = F.size(pieces)
    kept = F.slice(pieces, F.greatest(n - most, F.lit(0)) + 1, F.lit(max(most, 0))) if top else F.slice(pieces, F.lit(1), F.lit(max(most, 0)))
    return F.when(n <= most, text).otherwise(F.array_join(kept, ""))
